"""Exact distinct counts by bitmaps: one pass for any number of conditions, and counts of days that add up to weeks.

An id is a bit of one of the bitmaps of 32,768 ids each. Bitmaps of a group are unions of its rows' bits, made on either
side of the shuffle, so no row is repeated for each condition and no id is shuffled once for each. Bitmaps of small groups can
be kept and united to larger ones; counts can't. Best for ids that lie close together: a bitmap takes 4 kB, however few of
its bits are set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = "__ids"


def id_bitmaps(df: DataFrame, by: dict[str, Column], id_col: str, wanted: dict[str, Column]) -> DataFrame:
    """The groups' columns, BUCKET, and a bitmap for each name in `wanted`: the ids of the rows for which its condition holds. Null ids are no ids."""
    bit = F.bitmap_bit_position(id_col)
    rows = df.filter(F.col(id_col).isNotNull()).select(*[c.alias(name) for name, c in by.items()], F.bitmap_bucket_number(id_col).alias(BUCKET), *[F.when(condition, bit).alias(name) for name, condition in wanted.items()])
    return rows.groupBy(*by, BUCKET).agg(*[F.bitmap_construct_agg(name).alias(name) for name in wanted])


def united(bitmaps: DataFrame, by: dict[str, Column], wanted: Sequence[str]) -> DataFrame:
    """Bitmaps of larger groups."""
    return bitmaps.groupBy(*[c.alias(name) for name, c in by.items()], BUCKET).agg(*[F.bitmap_or_agg(name).alias(name) for name in wanted])


def distinct_counts(bitmaps: DataFrame, by: Sequence[str], wanted: Sequence[str]) -> DataFrame:
    return bitmaps.groupBy(*by).agg(*[F.sum(F.bitmap_count(name)).alias(name) for name in wanted])

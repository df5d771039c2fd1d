"""Declarative checks; each returns the failing rows, so an empty result is a pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_null(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNull())


def unique(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def unique_combination(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def accepted_values(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    return df.filter(F.col(col).isNotNull() & ~F.col(col).isin(*values))


def relationships(child: DataFrame, col: str, parent: DataFrame, parent_col: str, where: str | None = None) -> DataFrame:
    rows = child.filter(where) if where else child
    keys = parent.select(F.col(parent_col).alias("_parent"))
    return rows.filter(F.col(col).isNotNull()).join(keys, F.col(col) == F.col("_parent"), "left_anti")


def outside(col: str, low=None, high=None, strictly: bool = False) -> Column:
    """Whether a value that isn't null lies outside the bounds."""
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col(col) <= low if strictly else F.col(col) < low)
    if high is not None:
        bad = bad | (F.col(col) >= high if strictly else F.col(col) > high)
    return F.col(col).isNotNull() & bad


def between(df: DataFrame, col: str, low=None, high=None, strictly: bool = False) -> DataFrame:
    return df.filter(outside(col, low, high, strictly))


def failures(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check_name, failures: how many rows fail each check of single rows, in one scan."""
    sums = df.agg(*[F.count_if(bad).alias(name) for name, bad in checks.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).alias("failures")) for n in checks])).alias("r")).select("r.*")

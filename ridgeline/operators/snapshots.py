"""Histories of entities that are kept from run to run, in an open and a closed part.

A run compares the source with the open rows alone. Rows that it closes move to the closed part as new files beside the old
ones, the open part is written again, and both are published as one version; closed files are never read or written again.
So a run's work follows the number of entities, however long their history is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.history import scd2_apply
from ridgeline.operators.store import Store

PART = "__part"


def _parted(rows: DataFrame) -> DataFrame:
    return rows.withColumn(PART, F.when(F.col("valid_to").isNull(), "open").otherwise("closed"))


def snapshot(store: Store, name: str, source: DataFrame, key: str, updated_at: str, now: Column) -> DataFrame:
    """Takes the source's state into the history, and gives the history: the source's columns, scd_id, valid_from, valid_to.

    A row whose `updated_at` is newer than the open one's closes that and opens another; an open row that the source lacks
    closes `now`. A state that is taken again changes nothing.
    """
    if store.exists(name):
        opened = [x for x in store.current(name)["folders"] if x.endswith(f"{PART}=open")]
        store.change(name, opened, lambda old: _parted(scd2_apply(old.drop(PART), source, key, updated_at, now)))
    else:
        none = F.lit(None).cast(source.schema[updated_at].dataType)
        nothing = source.filter(F.lit(False)).select("*", F.lit("").alias("scd_id"), none.alias("valid_from"), none.alias("valid_to"))
        store.replace(name, _parted(scd2_apply(nothing, source, key, updated_at, now)), PART)
    return history(store, name)


def history(store: Store, name: str) -> DataFrame:
    return store.read(name).drop(PART)

"""Incremental models: lookback windows, and the strategies that apply their rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators.deltas import merge_delta
from ridgeline.operators.evolve import align, sync_all
from ridgeline.operators.history import merge_upsert
from ridgeline.operators.store import Staged, Store

#: Where an empty target starts.
FIRST_DAY = dt.date(2024, 1, 1)


def lookback_from_max(source: DataFrame, col: str, target: DataFrame, target_col: str, days: int = 3) -> DataFrame:
    """Source rows from `days` before the target's last day. The day is read first, so the filter is a literal that
    prunes partitions and reaches the scan."""
    last = target.agg(F.max(target_col)).first()[0] or FIRST_DAY
    return source.filter(F.col(col) >= F.lit(last - dt.timedelta(days=days)))


def lookback_from_clock(source: DataFrame, col: str, today: dt.date, days: int = 7) -> DataFrame:
    return source.filter(F.col(col) >= F.lit(today - dt.timedelta(days=days)))


def run_model(store: Store, name: str, rows: DataFrame, strategy: str, keys: Sequence[str] = (), partition: str | None = None, full_refresh: bool = False, checks: dict[str, Column] | None = None) -> DataFrame:
    """Applies a model's rows to its table: full, merge (on keys) or insert_overwrite (of the partitions in the rows).

    A table that is merged without a partition grows by increments in buckets of its key (`deltas`), and nothing of it is read
    or written again. In a partitioned one, only folders that hold a key of the rows (merge), or a partition of theirs
    (insert_overwrite), are written again; rows with new keys come as new folders. A day that became empty keeps its old rows.
    Columns follow the rows' in a merge (new ones are null in old rows, absent ones go); insert_overwrite keeps those that
    either has. The rows are computed once. checks: as in `Store.replace`.
    """
    if strategy == "merge" and partition is None and (full_refresh or not store.exists(name) or store.current(name)["merge"]):
        if full_refresh:
            store.drop(name)
        merge_delta(store, name, rows, keys, follow=True)
    elif full_refresh or not store.exists(name):
        store.replace(name, rows, partition, checks=checks)
    elif strategy == "merge":
        with Staged(store, name, rows) as staged:  # which folders it touches is asked first
            store.change(name, store.matched(name, staged, keys), lambda old: merge_upsert(sync_all(old, staged), staged, keys, None), checks=checks)
    elif strategy == "insert_overwrite":
        target, fresh = align(store.read(name), rows)
        if partition and store.current(name)["partition"] != [partition]:  # laid out anew, once
            store.replace(name, target.join(fresh.select(partition).distinct(), partition, "left_anti").select(*target.columns).unionByName(fresh), partition)
        else:
            store.overwrite_partitions(name, fresh, checks=checks)
    elif strategy == "append":
        store.change(name, [], lambda old: sync_all(old, rows).unionByName(rows))
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return store.read(name)


def load_hour(store: Store, name: str, rows: DataFrame | None, partition: str) -> str:
    """Loads the change rows of an hour into its partition, which they replace: 'loaded', or 'skipped' where there are no files (None).

    Running an hour again gives the same table. Columns that the rows add are null in earlier hours.
    """
    if rows is None:
        return "skipped"
    run_model(store, name, rows, "insert_overwrite", partition=partition)
    return "loaded"


def overwrite_partitions(spark: SparkSession, rows: DataFrame, path: str, partition: Sequence[str]) -> None:
    """Replaces only the partitions that the rows hold; running it again gives the same table."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)

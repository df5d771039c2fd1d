"""Loads of a table by steps of time (hours, days) that make up for what is missing.

A control table holds what became of each step: loaded, skipped (no files came) or failed. What is neither loaded nor
skipped is missing; a run loads it, the oldest first and a few at once, and says what became of each.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, as_completed

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgeline.operators.deltas import merge_delta
from ridgeline.operators.store import Store

CONTROL = "_steps"
SCHEMA = "table string, step timestamp_ntz, status string, tries int, error string, noted_at timestamp_ntz"


def note(store: Store, rows: list[tuple]) -> None:
    """Adds what became of steps; the last note of a step counts."""
    merge_delta(store, CONTROL, store.spark.createDataFrame(rows, SCHEMA), ["table", "step"], buckets=1)


def notes(store: Store, table: str) -> DataFrame:
    if not store.exists(CONTROL):
        return store.spark.createDataFrame([], SCHEMA)
    return store.read(CONTROL).filter(F.col("table") == table)


def missing(store: Store, table: str, first: dt.datetime, last: dt.datetime, step: dt.timedelta) -> DataFrame:
    """begin, end, steps: the gaps in [first, last), each a longest run of steps that are neither loaded nor skipped."""
    n = -(-(last - first) // step)
    seconds = int(step.total_seconds())
    at = F.timestamp_add("SECOND", F.col("id") * seconds, F.lit(first).cast("timestamp_ntz"))
    done = notes(store, table).filter(F.col("status").isin("loaded", "skipped")).select("step")
    open_ = store.spark.range(n).select("id", at.alias("step")).join(done, "step", "left_anti")
    # in a run of steps the number less its rank stays the same
    island = F.col("id") - F.row_number().over(Window.partitionBy(F.lit(table)).orderBy("id"))
    found = open_.withColumn("_i", island).groupBy("_i").agg(F.min("step").alias("begin"), F.max("step").alias("end"), F.count(F.lit(1)).alias("steps"))
    return found.select("begin", F.timestamp_add("SECOND", F.lit(seconds), F.col("end")).alias("end"), "steps")


def catch_up(store: Store, table: str, first: dt.datetime, last: dt.datetime, step: dt.timedelta, ready: Callable[[dt.datetime], bool], load: Callable[[dt.datetime], object], now: dt.datetime, at_once: int = 2, tries: int = 2) -> dict[dt.datetime, str]:
    """Loads the missing steps of [first, last), and gives what became of each.

    `ready(step)` says whether its files are there; if not it is skipped. `load(step)` must replace what an earlier try left.
    At most `at_once` steps run side by side, each in a scheduler pool of its own; one that fails is tried again, then noted as
    failed, and the others go on. A run after a whole one loads nothing. A first load, which makes the table, runs alone.
    """
    todo = [r["begin"] + k * step for r in missing(store, table, first, last, step).orderBy("begin").collect() for k in range(r["steps"])]
    context = store.spark.sparkContext

    def one(k: int, at: dt.datetime) -> tuple[str, int, str | None]:
        context.setLocalProperty("spark.scheduler.pool", f"{table}-{k % at_once}")
        if not ready(at):
            return "skipped", 0, None
        for turn in range(1, tries + 1):
            try:
                load(at)
                return "loaded", turn, None
            except Exception as e:  # noqa: BLE001  the step is noted as failed
                error = f"{type(e).__name__}: {e}"[:500]
        return "failed", tries, error

    became = {}
    with ThreadPoolExecutor(at_once) as threads:
        while todo and not store.exists(table):
            at = todo.pop(0)
            became[at] = threads.submit(one, 0, at).result()
        running = {threads.submit(one, k, at): at for k, at in enumerate(todo)}
        for done in as_completed(running):
            became[running[done]] = done.result()
    if became:
        note(store, [(table, at, status, turns, error, now) for at, (status, turns, error) in sorted(became.items())])
    return {at: status for at, (status, _, _) in became.items()}

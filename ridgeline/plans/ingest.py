"""Batch ingest: a window of an operational table into its bronze table, by the table's declaration."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.schema import TableConfig
from ridgeline.operators.deltas import merge_delta
from ridgeline.operators.evolve import sync_report
from ridgeline.operators.store import Store, table_labels
from ridgeline.sources.connectors import extract

#: The column that the buckets of a bronze table are partitioned by: its time, cut to the declared unit.
PART = "_part"
#: The table of a store that says what was loaded from where.
LINEAGE = "_lineage"


@dataclass(frozen=True)
class Load:
    """What an ingest did: what became of the schema, and the labels that its jobs bear."""

    table: str
    schema: str
    labels: dict[str, str]


def bronze(store: Store, config: TableConfig) -> DataFrame:
    """A bronze table without its partition column."""
    return store.read(config.name).drop(PART)


def ingest(store: Store, config: TableConfig, source: DataFrame, window: tuple | None, now: dt.datetime, labels: dict[str, str] | None = None, own_labels: dict[str, str] | None = None) -> Load:
    """Extracts a window (None: everything) of the source and merges it into the table; running it again changes nothing.

    The source is read once: the window's rows are added as an increment (`deltas`), so nothing that comes or moves meanwhile
    is taken twice. A table that only grows keeps the first row of a key. In others a row replaces the stored one of its key if
    its version is newer, or (where the table says so) not older. Columns that either side lacks are null there. The first run
    makes the table, partitioned by hour, day, month or year and clustered as declared. Each run adds a row to the lineage table.
    """
    rows = extract(source, config, window, now)
    unit = F.date_trunc(config.unit, F.col(config.partition_col))
    rows = rows.withColumn(PART, unit.cast("timestamp_ntz") if config.unit == "hour" else F.to_date(unit))
    report = sync_report(store.read(config.name).schema if store.exists(config.name) else None, rows.schema)
    if config.append_only:
        rule, version, order = "first", None, [F.col(config.window_col).desc_nulls_last()]
    else:
        rule, version, order = "not older" if not config.strict else "newer", config.version_col, []
        rule = rule if version else "last"
    merge_delta(store, config.name, rows, config.keys, rule, version, order, partition=[PART], cluster=config.cluster)
    made = table_labels(config.name, config.source_system, labels, own_labels)
    spark = source.sparkSession
    line = spark.createDataFrame([(config.source_system, config.name, str(window and window[0]), str(window and window[1]), report, now, made)], "source string, target string, window_start string, window_end string, schema string, loaded_at timestamp_ntz, labels map<string,string>")
    if store.exists(LINEAGE):
        store.change(LINEAGE, [], lambda old: line)
    else:
        store.replace(LINEAGE, line)
    return Load(config.name, report, made)

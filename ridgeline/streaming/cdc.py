"""Change streams: hourly buckets that a replay replaces, current state by key, upserts, dead letters."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ridgeline.functions.expressions import to_zone
from ridgeline.operators.deltas import merge_delta
from ridgeline.operators.store import Store, shared_folder

#: What orders the changes of a key: time of the source, then position in its log.
ORDER = ("__source_ts_ms", "__lsn")


@dataclass(frozen=True)
class SinkSettings:
    """When a sink begins a new file: after so many records, and with each trigger."""

    most_records: int
    trigger: str


#: Thresholds of the two object stores.
SINKS = {"gcs": SinkSettings(50_000, "1 hour"), "minio": SinkSettings(1_000, "10 minutes")}


def _base(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def flatten_envelope(df: DataFrame, table: str) -> DataFrame:
    """A raw change envelope (before, after, op, ts_ms, source.lsn) as its row with __op, __table, __lsn and __source_ts_ms.

    A delete keeps the row before it, marked `d`; records without any row are dropped.
    """
    row = F.coalesce("after", "before")
    out = df.filter(row.isNotNull()).withColumn("_row", row)
    return out.select("_row.*", F.col("op").alias("__op"), F.lit(table).alias("__table"), F.col("source.lsn").alias("__lsn"), F.col("ts_ms").alias("__source_ts_ms"))


def split_bad(df: DataFrame, schema: T.StructType, now: Column | None = None, text_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """JSON records that parse as the schema, and the others for the dead-letter path: the text with headers that say why, from where and when."""
    parsed = df.withColumn("_r", F.from_json(text_col, T.StructType([*schema, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("_r").isNull() | F.col("_r._bad").isNotNull()
    headers = F.create_map(F.lit("error"), F.when(F.col(text_col).isNull(), "no value").otherwise("not a record of the schema"), F.lit("schema"), F.lit(schema.simpleString()))
    return parsed.filter(~bad).select(*[F.col(f"_r.{n}").alias(n) for n in schema.names]), parsed.filter(bad).select(F.col(text_col).alias("value"), headers.alias("headers"), (F.current_timestamp() if now is None else now).alias("failed_at"))


def parse_strict(df: DataFrame, schema: T.StructType, text_col: str = "value") -> DataFrame:
    """JSON records as the schema; the first that isn't one ends the run."""
    return df.select(F.from_json(text_col, schema, {"mode": "FAILFAST"}).alias("_r")).select("_r.*")


def file_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The files of a folder, or those that match the last part of the path, as a stream."""
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", 64).parquet(folder)


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], offsets: str, mode: str = "append") -> None:
    """Runs `each(batch, id)` over all that is there, then stops; a batch that is run again has the same id."""
    stream.writeStream.foreachBatch(each).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", offsets).start().awaitTermination()


def latest_changes(changes: DataFrame, key: str) -> DataFrame:
    """The last change of each key, by ORDER; sums of maxima come before the shuffle."""
    return changes.groupBy(key).agg(F.max_by(F.struct(*changes.columns), F.struct(*ORDER)).alias("r")).select("r.*")


def _own_store(spark: SparkSession) -> Store:
    return Store(spark, _base(spark))


def replay_stream(stream: DataFrame, key: str, changes: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Current state by key after a stream of changes.

    `changes` makes change records (with __op and ORDER) of a batch. Each batch is cut to its latest change of each key and
    merged into a table of increments, which is compacted as it grows; a repeated batch changes nothing. Late and repeated
    events are ranked, never dropped.
    """
    return upsert_sink(stream, _own_store(stream.sparkSession), "state", key, changes)


def bootstrap(snapshot: DataFrame, stream: DataFrame, key: str, changes: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Current state after a snapshot that was taken once and the stream of changes since; the two may overlap.

    The snapshot is the first increment of the table that the stream is merged into.
    """
    store = _own_store(stream.sparkSession)
    upsert_changes(store, "state", changes(snapshot), key)
    return upsert_sink(stream, store, "state", key, changes)


def state_stream(stream: DataFrame, store: Store, name: str, key: str, changes: Callable[[DataFrame], DataFrame] = lambda df: df, offsets: str | None = None) -> DataFrame:
    """Current state by key, kept in Spark's state store: the change of the largest ORDER of each key, updated by every batch.

    Only keys whose change is another one after a batch leave it, as an increment of the table `name`; that the state
    store knows the winner makes the last increment the one that counts. With `offsets` (a folder) a stream that stopped
    goes on where it was: the state of the last whole batch is read back, and a batch that was cut off runs again and adds the
    same rows. The state has one row a key; it is dealt to `spark.sql.shuffle.partitions` of the first start.
    """
    made = changes(stream)
    state = made.groupBy(key).agg(F.max_by(F.struct(*made.columns), F.struct(*ORDER)).alias("r")).select("r.*")

    def each(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            merge_delta(store, name, batch, [key], "last")

    drain(state, each, offsets or f"{_base(stream.sparkSession)}/offsets", "update")
    return store.read(name).filter(F.coalesce(F.col("__op"), F.lit("")) != "d")


def upsert_changes(store: Store, name: str, batch: DataFrame, key: str, most: int = 8) -> None:
    """Merges a batch of changes into a table by key, the newer by ORDER winning; columns that either side lacks are null there.

    A delete stays as a row marked `d`, so that an older change that comes late doesn't bring the key back. A batch that is
    merged again changes nothing. The batch is added as an increment (`deltas`): what is there is neither read nor
    written, but for buckets that hold more than `most` increments, which are compacted.
    """
    fresh = latest_changes(batch, key).withColumn("__version", F.struct(*ORDER))
    merge_delta(store, name, fresh, [key], "newer", "__version", most=most)


def upserted(store: Store, name: str) -> DataFrame:
    """The rows of a table of `upsert_changes` that aren't deleted."""
    return store.read(name).filter(F.coalesce(F.col("__op"), F.lit("")) != "d").drop("__version")


def upsert_sink(stream: DataFrame, store: Store, name: str, key: str, changes: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    drain(stream, lambda batch, _: upsert_changes(store, name, changes(batch), key), f"{_base(stream.sparkSession)}/offsets")
    return upserted(store, name)


def dead_letter_sink(stream: DataFrame, schema: T.StructType, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Records of a JSON stream that parse, and the dead letters, each kept under its batch."""
    base = _base(stream.sparkSession)

    def each(batch: DataFrame, batch_id: int) -> None:
        for name, rows in zip(("good", "bad"), split_bad(batch, schema, now)):
            rows.write.mode("overwrite").parquet(f"{base}/{name}/batch={batch_id}")

    drain(stream, each, f"{base}/offsets")
    return tuple(stream.sparkSession.read.parquet(f"{base}/{name}") for name in ("good", "bad"))


def hour_folders(zone: str, now: Column | None = None) -> dict[str, Column]:
    """year, month, day and hour of the clock on a zone's wall (or of the UTC time that is given in its place)."""
    at = to_zone(F.expr("cast(current_timestamp() as timestamp_ntz)") if now is None else now, zone)
    return {unit: F.date_format(at, pattern) for unit, pattern in (("year", "yyyy"), ("month", "MM"), ("day", "dd"), ("hour", "HH"))}


def start_sink(stream: DataFrame, folder: str, offsets: str, settings: SinkSettings, zone: str = "Asia/Jakarta", now: Column | None = None, live: bool = True) -> StreamingQuery:
    """Starts a sink into folders of the wall-clock hour at which rows come, whatever time they bear.

    A new file begins with every trigger of the settings, and after so many records. A live sink runs on; else it takes
    what is there and stops. A repeated batch replaces itself.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        dated = batch.withColumns(hour_folders(zone, now))
        dated.write.mode("overwrite").option("maxRecordsPerFile", settings.most_records).partitionBy("year", "month", "day", "hour").parquet(f"{folder}/batch={batch_id}")

    when = {"processingTime": settings.trigger} if live else {"availableNow": True}
    return stream.writeStream.foreachBatch(each).trigger(**when).option("checkpointLocation", offsets).start()


def clock_sink(stream: DataFrame, settings: SinkSettings = SINKS["gcs"], zone: str = "Asia/Jakarta", now: Column | None = None) -> DataFrame:
    """What a sink of clock folders makes of all that is there."""
    base = _base(stream.sparkSession)
    start_sink(stream, f"{base}/rows", f"{base}/offsets", settings, zone, now, live=False).awaitTermination()
    return stream.sparkSession.read.option("basePath", f"{base}/rows").parquet(f"{base}/rows")


def hourly_sink(stream: DataFrame, time_col: str = "ts", zone: str = "Asia/Jakarta", settings: SinkSettings = SINKS["gcs"]) -> DataFrame:
    """A stream in folders (load_hour) of the hour that its rows bear, on a zone's clock; a repeated batch replaces itself."""
    base = _base(stream.sparkSession)

    def each(batch: DataFrame, batch_id: int) -> None:
        hour = F.date_format(to_zone(F.col(time_col), zone), "yyyy-MM-dd HH")
        batch.withColumn("load_hour", hour).repartition("load_hour").write.mode("overwrite").option("maxRecordsPerFile", settings.most_records).partitionBy("load_hour").parquet(f"{base}/hours/batch={batch_id}")

    drain(stream, each, f"{base}/offsets")
    return stream.sparkSession.read.option("basePath", f"{base}/hours").parquet(f"{base}/hours").withColumn("load_hour", F.col("load_hour").cast("string"))

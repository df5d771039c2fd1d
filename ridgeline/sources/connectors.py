"""Readers of operational stores and change streams. JDBC, Kafka and Avro need jars that may be absent; their options
are built here and checked by tests, and a missing format is reported before anything runs."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.functions.schema import TableConfig, cast_columns
from ridgeline.operators.history import in_window, latest_by



def jdbc_options(url: str, table: str, key: str, bounds: tuple[int, int], partitions: int, fetch: int = 10_000) -> dict[str, str]:
    """A scan split by ranges of the key, so that no one connection reads all rows."""
    return {"url": url, "dbtable": table, "partitionColumn": key, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions), "fetchsize": str(fetch), "pushDownPredicate": "true"}


def kafka_options(servers: str, topics: list[str], starting: str = "earliest") -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "startingOffsets": starting, "failOnDataLoss": "true"}


def has_format(spark: SparkSession, name: str) -> bool:
    lookup = spark.sparkContext._jvm.org.apache.spark.sql.execution.datasources.DataSource
    try:
        lookup.lookupDataSource(name, spark._jsparkSession.sessionState().conf())
        return True
    except Exception:
        return False


def _require(spark: SparkSession, name: str, why: str) -> None:
    if not has_format(spark, name):
        raise ValueError(f"the format {name} is not on the class path: add {why}")


def has_driver(spark: SparkSession, url: str) -> bool:
    """Whether a JDBC driver on the class path takes a url."""
    try:
        spark.sparkContext._jvm.java.sql.DriverManager.getDriver(url)
        return True
    except Exception:
        return False


def read_jdbc(spark: SparkSession, url: str, config: TableConfig, bounds: tuple[int, int], partitions: int, properties: dict[str, str] | None = None) -> DataFrame:
    """The declared columns of a table, scanned in ranges of its first key; the window's filter goes to the source."""
    if not has_driver(spark, url):
        raise ValueError(f"no JDBC driver takes {url.split('//')[0]}: add its jar")
    return spark.read.format("jdbc").options(**jdbc_options(url, config.name, config.keys[0], bounds, partitions), **(properties or {})).load().select(*config.selected)


def read_topics(spark: SparkSession, servers: str, topics: list[str], schema: str, stream: bool = True, starting: str = "earliest") -> DataFrame:
    """Avro records of topics as `record`, with topic, partition and offset; the schema is Avro's, in JSON."""
    _require(spark, "kafka", "spark-sql-kafka")
    _require(spark, "avro", "spark-avro")
    from pyspark.sql.avro.functions import from_avro

    reader = (spark.readStream if stream else spark.read).format("kafka").options(**kafka_options(servers, topics, starting))
    return reader.load().select(from_avro("value", schema).alias("record"), "topic", "partition", "offset")


def cdc_path(topic: str, hour: dt.datetime) -> str:
    """The folder of an hour of Jakarta wall clock."""
    return f"raw/cdc/{topic}/year={hour:%Y}/month={hour:%m}/day={hour:%d}/hour={hour:%H}"


def _moved(at: dt.datetime, old: str, new: str) -> dt.datetime:
    """A naive time of one zone's clock on another's."""
    return at.replace(tzinfo=ZoneInfo(old)).astimezone(ZoneInfo(new)).replace(tzinfo=None)


def partition_suffix(hour: dt.datetime, zone: str = "Asia/Jakarta") -> str:
    """The UTC partition name of an hour on a zone's clock."""
    return f"{_moved(hour, zone, 'UTC'):%Y%m%d%H}"


def probe(spark: SparkSession, path: str) -> str:
    """'ready' if the folder holds a Parquet file, else 'skipped'; a table without news is no error."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/*.parquet")
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return "ready" if found is not None and len(found) else "skipped"


def resolve_window(conf: dict | None, start: dt.datetime, end: dt.datetime, zone: str = "UTC") -> tuple[dt.datetime, dt.datetime]:
    """The run's window (UTC), or the one asked for by hand, on the clock of the source's zone, summer time and all; an empty one is refused."""
    if conf and conf.get("window_start") and conf.get("window_end"):
        start, end = (dt.datetime.fromisoformat(conf[k]) for k in ("window_start", "window_end"))
    else:
        start, end = (_moved(x, "UTC", zone) for x in (start, end))
    if start >= end:
        raise ValueError(f"empty window {start} .. {end}: give window_start and window_end")
    return start, end


def extract(source: DataFrame, config: TableConfig, window: tuple | None, now: dt.datetime) -> DataFrame:
    """Rows of a window, cast, cut to the latest of each key, with the metadata columns. The filter comes before the
    ranking and reaches the scan; window None is a full load."""
    rows = in_window(source, config.window_col, *window) if window else source
    typed = rows.select(*cast_columns(rows, config))
    order = [F.col(config.version_col or config.window_col).desc_nulls_last()]
    return latest_by(typed, config.keys, order).withColumns({"_ingested_at": F.lit(now).cast("timestamp_ntz"), "_source_system": F.lit(config.source_system)})


def read_changes(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Change files of all hours; columns that later hours add are null in earlier ones."""
    reader = spark.read.option("mergeSchema", "true")
    return (reader.schema(schema) if schema else reader).parquet(path)

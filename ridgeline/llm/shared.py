"""Tables in the shared folder, and Arrow column access, used by several operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_UNSET_DIRS: dict[str, str] = {}
#: Bytes of text that an Arrow function works on at once; its arrays take some hundred times that.
CHUNK = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or the checkpoint folder that was set, or (on a local master, as in tests) one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    existing = spark.sparkContext._jsc.sc().getCheckpointDir()
    if existing.isDefined():
        return existing.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _UNSET_DIRS:
        _UNSET_DIRS[app] = tempfile.mkdtemp(prefix="ridgeline-shared-")
    return "file://" + _UNSET_DIRS[app]


class Workspace:
    """Named Parquet tables below one fresh folder of the shared directory.

    A table written here cuts the lineage: a lost executor costs a re-read, not a recomputation.
    `drop` removes a table as soon as its readers are done; the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self.drop()
        except Exception:  # the JVM may be gone by then
            pass


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; null counts as empty."""
    col = col.fill_null("").cast(pa.large_string())
    _, offsets, data = col.buffers()
    ends = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    base = int(ends[0]) if len(ends) else 0
    return raw[base : int(ends[-1]) if len(ends) else 0], ends - base


def chunks(offsets: np.ndarray, limit: int):
    """Row ranges (first, last) of at most `limit` bytes each; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last

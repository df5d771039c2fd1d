"""Parquet tables as immutable folders, with a list of those that make up each version."""

from __future__ import annotations

import json
import re
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalise_label(value: str) -> str:
    """A billing label: lower case, each run of other characters than a-z and 0-9 as one '-', none at the ends, at most 63."""
    return "-".join(re.findall("[a-z0-9]+", value.lower()))[:63] or "unknown"


def merge_labels(dag: dict[str, str], auto: dict[str, str], table: dict[str, str]) -> dict[str, str]:
    return {normalise_label(k): normalise_label(v) for k, v in {**dag, **auto, **table}.items()}


def table_labels(table: str, source_system: str, dag: dict[str, str] | None = None, own: dict[str, str] | None = None) -> dict[str, str]:
    """The labels of a load: the job's, then table and source-system, then the table's own, which win."""
    return merge_labels(dag or {}, {"table": table, "source-system": source_system}, own or {})


#: The folder level that tells versions apart; no column may have its name.
FOLDER = "__folder"
_OWN: dict[str, str] = {}
#: Seconds after which a folder that no list names is taken for one of a run that broke off.
ORPHAN = 86_400
#: Threads of one driver write lists in turn.
_LOCK = threading.Lock()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the checkpoint folder that was set; on a local master one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    existing = spark.sparkContext._jsc.sc().getCheckpointDir()
    if existing.isDefined():
        return existing.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="ridgeline-")
    return "file://" + _OWN[app]


class ChecksFailed(ValueError):
    """A version that wasn't published: how many rows failed each check."""

    def __init__(self, table: str, failures: dict[str, int]):
        super().__init__(f"{table}: {failures}")
        self.failures = failures


@dataclass
class Store:
    """Tables below a root; any path that Spark's file systems know. A reader sees whole versions only.

    Rows lie in data/__folder=N/<partitions>; _versions/N.json lists the folders of version N and its schema. A list is written
    under another name and renamed, and never deleted before a newer one is there, so a crash at any point leaves the
    version before. A change of some partitions writes those, and lists the others where they are.
    """

    spark: SparkSession
    root: str

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[int]:
        path, fs = self._fs(f"{self.root}/{name}/_versions")
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"(\d+)\.json", n)))

    def _list(self, name: str, version: int) -> dict:
        path, fs = self._fs(f"{self.root}/{name}/_versions/{version:08d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self, name: str) -> dict:
        """version, schema, partition and folders of the newest whole version."""
        for turn in range(10):
            versions = self._versions(name)
            if not versions:
                raise ValueError(f"no table {name}")
            try:
                return {"merge": None, **self._list(name, versions[-1])}
            except Exception:  # other runs made two more versions meanwhile, and the list is gone
                if versions[-1] in self._versions(name) or turn == 9:
                    raise

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    @staticmethod
    def schema(now: dict) -> T.StructType:
        return T.StructType.fromJson(now["schema"])

    def scan(self, name: str, now: dict, folders: Sequence[str]) -> DataFrame:
        """The rows of some folders of a version, as they lie."""
        schema = self.schema(now)
        if not folders:
            return self.spark.createDataFrame([], schema)
        base = f"{self.root}/{name}/data"
        full = T.StructType([*schema, T.StructField(FOLDER, T.StringType())])
        return self.spark.read.schema(full).option("basePath", base).parquet(*[f"{base}/{x}" for x in folders]).select(*schema.names)

    def read(self, name: str) -> DataFrame:
        """The rows of the newest version; of a table that is merged into by increments, those that count."""
        now = self.current(name)
        if now["merge"] is not None:
            from ridgeline.operators.deltas import merged

            return merged(self, name, now)
        return self.scan(name, now, now["folders"])

    def read_partitions(self, name: str, column: str, predicate: Column | None) -> DataFrame:
        """For tables whose scans must name partitions: a predicate that doesn't bound the column is an error.

        The optimised plan is asked: it must have a filter on that column alone that is more than a test for null.
        """
        if predicate is None:
            raise ValueError(f"{name}: a predicate on {column} is required")
        rows = self.read(name).filter(predicate)
        if not _bounds(rows, column):
            raise ValueError(f"{name}: the predicate doesn't bound {column}")
        return rows

    def create(self, name: str, schema: T.StructType) -> None:
        if not self.exists(name):
            self.replace(name, self.spark.createDataFrame([], schema))

    def _reserve(self, name: str) -> int:
        """A folder number that no other run has: whoever makes its mark first has it."""
        path, fs = self._fs(f"{self.root}/{name}/data")
        used = [int(m[1]) for x in (fs.listStatus(path) if fs.exists(path) else []) if (m := re.fullmatch(FOLDER + r"=(\d+)", x.getPath().getName()))]
        number = max([0, *used, *self._versions(name)]) + 1
        while not fs.createNewFile(self._fs(f"{self.root}/{name}/_taken/{number:08d}")[0]):
            number += 1
        return number

    def _write(self, name: str, df: DataFrame, partition: Sequence[str], cluster: Sequence[str], merge: dict | None = None) -> list[str]:
        """The new folders with the rows, which no list names yet: one for each partition, of a merged table one for each bucket."""
        number = self._reserve(name)
        path, fs = self._fs(f"{self.root}/{name}/data")
        out = df.sortWithinPartitions(*cluster) if cluster else df
        (out.write.partitionBy(*partition) if partition else out.write).option("compression", "zstd").parquet(f"{path}/{FOLDER}={number:08d}")
        found = fs.globStatus(self._fs(f"{path}/{FOLDER}={number:08d}{'/*=*' * (1 if merge else len(partition))}")[0])
        return sorted(str(x.getPath()).split("/data/", 1)[1] for x in found or [])

    def _commit(self, name: str, schema: T.StructType, partition: Sequence[str], fresh: Iterable[str], gone: Callable[[str], bool], merge: dict | None = None, extra: dict | None = None) -> int:
        """A new version: the newest one's folders but those that are `gone`, and the fresh ones; its number.

        Runs that end side by side each add to what the other left: the list is made of the newest one when it is renamed into
        place, and made again if another run took its number. The version that a run replaces folders of must still hold them.
        """
        fresh = list(fresh)
        for _ in range(100):
            with _LOCK:
                versions = self._versions(name)
                held = self._list(name, versions[-1])["folders"] if versions else []
                number = max([0, *versions, *(int(re.match(FOLDER + r"=(\d+)", x)[1]) for x in fresh)]) + (not fresh or bool(versions) and versions[-1] >= max(int(re.match(FOLDER + r"=(\d+)", x)[1]) for x in fresh))
                text = json.dumps({"version": number, "schema": schema.jsonValue(), "partition": list(partition), "folders": sorted([*(x for x in held if not gone(x)), *fresh]), "merge": merge, **(extra or {})})
                made, fs = self._fs(f"{self.root}/{name}/_versions/.{uuid.uuid4().hex}")
                stream = fs.create(made, True)
                stream.write(bytearray(text.encode()))
                stream.close()
                place = self._fs(f"{self.root}/{name}/_versions/{number:08d}.json")[0]
                if not fs.exists(place) and fs.rename(made, place):
                    self._clean(name)
                    return number
                fs.delete(made, False)
        raise RuntimeError(f"{name}: other runs took a hundred versions in turn")

    def _clean(self, name: str) -> None:
        """Drops lists older than the last two, and folders that neither of those names; those of runs that broke off before their list once they are ORPHAN old."""
        versions = self._versions(name)
        kept = {x for v in versions[-2:] for x in self._list(name, v)["folders"]}
        for v in versions[:-2]:
            old = self._list(name, v)
            for folder in set(old["folders"]) - kept:
                path, fs = self._fs(f"{self.root}/{name}/data/{folder}")
                fs.delete(path, True)
            path, fs = self._fs(f"{self.root}/{name}/_versions/{v:08d}.json")
            fs.delete(path, False)
        listed = {x.split("/", 1)[0] for x in kept}
        path, fs = self._fs(f"{self.root}/{name}/data")
        for x in fs.listStatus(path) if fs.exists(path) else []:
            if x.getPath().getName() not in listed and x.getModificationTime() < time.time() * 1000 - ORPHAN * 1000:
                fs.delete(x.getPath(), True)

    def replace(self, name: str, df: DataFrame, partition: str | Sequence[str] | None = None, cluster: Sequence[str] = (), merge: dict | None = None, checks: dict[str, Column] | None = None) -> int:
        """The whole table anew; the version before stays for running readers.

        merge: how increments are ranked (`deltas`). checks: what no row may be, by name; one that is keeps the version from
        being published. They are counted in the job that writes, so the rows are computed once.
        """
        columns = [partition] if isinstance(partition, str) else list(partition or ())
        folders = self._written(name, df, columns, cluster, checks, merge)
        return self._commit(name, df.schema, columns, folders, lambda x: True, merge)

    def _written(self, name: str, df: DataFrame, partition: Sequence[str], cluster: Sequence[str], checks: dict[str, Column] | None, merge: dict | None = None) -> list[str]:
        """As `_write`; the rows that fail a check are counted as they are written, and if there are any the folders go again."""
        if not checks:
            return self._write(name, df, partition, cluster, merge)
        seen = Observation()
        folders = self._write(name, df.observe(seen, *[F.count_if(bad).alias(check) for check, bad in checks.items()]), partition, cluster, merge)
        failed = {check: n for check, n in seen.get.items() if n} if folders else {}
        if failed:
            for folder in folders:
                path, fs = self._fs(f"{self.root}/{name}/data/{folder}")
                fs.delete(path, True)
            raise ChecksFailed(name, failed)
        return folders

    def overwrite_partitions(self, name: str, rows: DataFrame, cluster: Sequence[str] = (), checks: dict[str, Column] | None = None) -> int:
        """Replaces the partitions that the rows hold; the others stay where they are."""
        now = self.current(name)
        fresh = self._written(name, rows, now["partition"], cluster, checks)
        places = {x.split("/", 1)[-1] for x in fresh}
        return self._commit(name, rows.schema, now["partition"], fresh, lambda x: x.split("/", 1)[-1] in places)

    def matched(self, name: str, rows: DataFrame, keys: Sequence[str]) -> list[str]:
        """The folders with a row that has the keys of one of `rows`; only the keys are read."""
        now = self.current(name)
        if not now["folders"]:
            return []
        base = f"{self.root}/{name}/data"
        full = T.StructType([*T.StructType.fromJson(now["schema"]), T.StructField(FOLDER, T.StringType())])
        held = self.spark.read.schema(full).option("basePath", base).parquet(*[f"{base}/{x}" for x in now["folders"]])
        file = F.regexp_extract(F.col("_metadata.file_path"), rf"/data/({FOLDER}=\d+(?:/[^/]+)*)/[^/]+$", 1)
        return sorted(unquote(r[0]) for r in held.select(*keys, file.alias("_folder")).join(rows.select(*keys).distinct(), list(keys), "left_semi").select("_folder").distinct().collect())

    def change(self, name: str, folders: Sequence[str], make, cluster: Sequence[str] = (), checks: dict[str, Column] | None = None) -> int:
        """Replaces the rows of some folders by what `make` gives for them; the others stay where they are."""
        now = self.current(name)
        rows = make(self.scan(name, now, folders))
        fresh, gone = self._written(name, rows, now["partition"], cluster, checks, now["merge"]), set(folders)
        return self._commit(name, rows.schema, now["partition"], fresh, lambda x: x in gone, now["merge"])

    def publish(self, name: str, schema: T.StructType, rows: DataFrame | None, extra: dict) -> int:
        """A version of the folders that are there, with the rows (None: none) in one more, another schema, and `extra` in its list."""
        return self._commit(name, schema, (), [] if rows is None else self._write(name, rows, (), ()), lambda x: False, None, extra)

    def load(self, name: str, rows: DataFrame, write: str = "truncate", create: bool = True, new_columns: bool = False, partition: Sequence[str] = (), cluster: Sequence[str] = ()) -> int:
        """Writes a query's rows to a table: in place of its rows (truncate), beside them (append), or only if it has none (empty).

        An absent table is made, or an error if `create` is off. Columns that the table lacks are an error unless
        `new_columns` admits them; those that the rows lack are null.
        """
        if not self.exists(name):
            if not create:
                raise ValueError(f"no table {name}")
            return self.replace(name, rows, list(partition), cluster)
        now = self.current(name)
        schema = T.StructType.fromJson(now["schema"])
        added = [f for f in rows.schema if f.name not in schema.names]
        if added and not new_columns:
            raise ValueError(f"{name} has no columns {[f.name for f in added]}")
        full = T.StructType([*schema, *added])
        aligned = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in full])
        if write == "empty" and not self.read(name).isEmpty():
            raise ValueError(f"{name} has rows")
        if write in ("truncate", "empty"):
            return self.replace(name, aligned, now["partition"], cluster)
        if write != "append":
            raise ValueError(f"unknown disposition {write}")
        return self.change(name, [], lambda old: aligned, cluster)

    def truncate(self, name: str) -> int:
        """An empty version of the table. Whoever draws ids from `next_id` begins at 1 again."""
        now = self.current(name)
        return self._commit(name, self.schema(now), now["partition"], [], lambda x: True, now["merge"])

    def next_id(self, name: str, column: str) -> int:
        """The first id that the table doesn't hold: one more than its largest, 1 if it is empty."""
        return (self.read(name).agg(F.max(column)).first()[0] or 0) + 1

    def drop(self, name: str) -> None:
        path, fs = self._fs(f"{self.root}/{name}")
        fs.delete(path, True)


def _bounds(rows: DataFrame, column: str) -> bool:
    """Whether the optimised plan's filters include one on the column alone that is more than a test for null."""
    seen, todo = False, [rows._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Filter":
            for part in _conjuncts(node.condition()):
                names = {x.name() for x in _items(part.references().toSeq())}
                seen = seen or names == {column} and part.nodeName().lower() not in ("isnotnull", "isnull", "not") and part.deterministic()
        elif not list(_items(node.children())) and node.nodeName() == "LocalRelation" and node.isEmpty():
            return True  # nothing can match
        todo += _items(node.children())
    return seen


def _items(seq):
    return (seq.apply(k) for k in range(seq.size()))


def _conjuncts(condition) -> list:
    if condition.nodeName() == "And":
        return [*_conjuncts(condition.left()), *_conjuncts(condition.right())]
    return [condition]


@dataclass
class Staged:
    """A table of one run, dropped at its end whether the run fails or not: `with Staged(store, "tmp", rows) as table`."""

    store: Store
    name: str
    rows: DataFrame

    def __enter__(self) -> DataFrame:
        self.own = f"{self.name}_{uuid.uuid4().hex}"
        try:
            self.store.replace(self.own, self.rows)
            return self.store.read(self.own)
        except BaseException:
            self.store.drop(self.own)
            raise

    def __exit__(self, *failure) -> None:
        self.store.drop(self.own)


def run_statements(spark: SparkSession, statements: Sequence[str], tables: dict[str, DataFrame] | None = None) -> DataFrame | None:
    """Runs SQL statements in order and gives the last one's rows.

    `tables` are views for the run alone, as is what `CREATE TEMPORARY VIEW` in a statement makes: a session of their own
    holds them, so that runs side by side don't meet. A statement that fails ends the run.
    """
    session = spark.newSession()
    for name, df in (tables or {}).items():
        moved = session.sparkContext._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, df._jdf.queryExecution().logical())
        DataFrame(moved, session).createTempView(name)
    out = None
    for text in statements:
        out = session.sql(text)
    return out


def truncated(col: str, unit: str) -> Column:
    """The partition value of a time column: day, month, year or hour."""
    return F.date_trunc(unit, F.col(col))


def write_query(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = (), cluster_by: Sequence[str] = ()) -> None:
    out = df.sortWithinPartitions(*cluster_by) if cluster_by else df
    writer = out.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)

"""Tables that are merged into by adding: increments lie beside the base, in buckets of the key, and readers rank them.

A merge writes the increment's rows alone, each in the bucket of its key, as folders of a new version; nothing that is there is
read or written again. A reader takes buckets of one increment as they lie, and ranks the rows of a key in the others by the
table's rule. Once a bucket holds more than `most` increments it is compacted: its ranked rows become one folder, and the other
buckets stay where they are. So the work of a merge follows the increment, and that of a compaction its buckets.

Rules, for the rows of a key in the order they came: `last` takes the last one, `first` the first one (tables that only grow),
`newer` the largest version, an earlier one of equals, and `not older` the same, a later one of equals. A row without a
version never replaces one, and is never replaced if it came first. Rows whose key is null are rows of one key.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.evolve import with_fields
from ridgeline.operators.history import latest_by
from ridgeline.operators.store import FOLDER, Store

#: Columns of a merged table beside its own: the bucket of the key, and the number of the increment.
BUCKET, SEQUENCE = "__bucket", "__sequence"
#: Parts of a bucket that tasks of a merge write.
PARTS = 64
RULES = ("last", "first", "newer", "not older")


def _buckets(folders: Sequence[str]) -> dict[int, list[str]]:
    """The folders of each bucket."""
    out: dict[int, list[str]] = {}
    for folder in folders:
        out.setdefault(int(re.search(rf"/{BUCKET}=(\d+)", folder)[1]), []).append(folder)
    return out


def _increments(folders: Sequence[str]) -> int:
    return len({re.match(rf"{FOLDER}=\d+", x)[0] for x in folders})


def _ranked(rows: DataFrame, merge: dict) -> DataFrame:
    """One row of each key, by the rule; sums of maxima come before the shuffle, so a hot key is no burden."""
    row, came = F.struct(*rows.columns), F.col(SEQUENCE)
    if merge["rule"] in ("last", "first"):
        best = (F.max_by if merge["rule"] == "last" else F.min_by)(row, came)
        return rows.groupBy(BUCKET, *merge["keys"]).agg(best.alias("_r")).select("_r.*")
    version = F.col(merge["version"])
    order = F.when(version.isNotNull(), F.struct(version.alias("v"), (came if merge["rule"] == "not older" else -came).alias("s")))
    made = rows.groupBy(BUCKET, *merge["keys"]).agg(F.min_by(version.isNull(), came).alias("_none"), F.min_by(row, came).alias("_first"), F.max_by(row, order).alias("_best"))
    return made.select(F.when(F.col("_none"), F.col("_first")).otherwise(F.col("_best")).alias("_r")).select("_r.*")


def merged(store: Store, name: str, now: dict) -> DataFrame:
    """The rows of a version; only buckets of several increments are ranked."""
    clean, dirty = [], []
    for folders in _buckets(now["folders"]).values():
        (clean if _increments(folders) == 1 else dirty).extend(folders)
    out = store.scan(name, now, clean)
    if dirty:
        out = out.unionByName(_ranked(store.scan(name, now, dirty), now["merge"]))
    return out.drop(BUCKET, SEQUENCE)


def merge_delta(store: Store, name: str, rows: DataFrame, keys: Sequence[str], rule: str = "last", version: str | None = None, order: Sequence[Column] = (), follow: bool = False, partition: Sequence[str] = (), cluster: Sequence[str] = (), buckets: int = 8, most: int = 8) -> int:
    """Merges an increment into a table, which it makes if there is none; its new version.

    `rows` are read once. Of a key's rows one is kept first: the first by `order`, else that of the largest version; of those that
    tie, the one with the largest hash. Columns that either side lacks are null there; with `follow` those that the rows lack go.
    keys, rule, version, partition and buckets are the table's, from its first merge on.
    """
    if store.exists(name):
        now = store.current(name)
        merge, partition, seen = now["merge"], now["partition"], now["version"]
        if merge is None:
            raise ValueError(f"{name} is not a table of increments")
        held = [f for f in store.schema(now) if f.name not in (BUCKET, SEQUENCE)]
        gone = [] if follow else [f for f in held if f.name not in rows.columns]
        rows = with_fields(rows, gone)
    else:
        if rule not in RULES or (version is None) != (rule in ("last", "first")):
            raise ValueError(f"the rule {rule} with the version {version}")
        merge, seen = {"keys": list(keys), "rule": rule, "version": version, "buckets": buckets}, 0
        partition = [BUCKET, *partition]
    by = list(order) or ([F.col(merge["version"]).desc_nulls_last()] if merge["version"] else [])
    fresh = latest_by(rows, merge["keys"], [*by, F.xxhash64(*[c for c, kind in rows.dtypes if not kind.startswith("map")]).desc()])
    placed = fresh.withColumn(BUCKET, F.pmod(F.xxhash64(*merge["keys"]), F.lit(merge["buckets"])).cast("int")).withColumn(SEQUENCE, F.lit(seen + 1).cast("long"))
    # parts of a bucket go to tasks of their own, so none writes a whole bucket; Spark puts small ones together by their sizes
    placed = placed.repartition(BUCKET, F.pmod(F.xxhash64(*merge["keys"], F.lit("part")), F.lit(PARTS)))
    if not seen:
        return store.replace(name, placed, partition, cluster, merge=merge)
    made = store.change(name, [], lambda old: placed, cluster)
    now = store.current(name)
    full = [x for folders in _buckets(now["folders"]).values() if _increments(folders) > most for x in folders]
    return store.change(name, full, lambda old: _ranked(old, merge), cluster) if full else made


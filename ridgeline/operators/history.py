"""Operators on versioned rows: deduplication, merges, change replay, SCD2 snapshots and joins as of a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgeline.functions.expressions import ZONE, format_local, surrogate_key


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order (rank filter: only a few rows a key leave each task)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).filter("_rn = 1").drop("_rn")


def in_window(df: DataFrame, col: str, start, end) -> DataFrame:
    """Half-open: start <= col < end. An empty window is an error, as it hides a wrong schedule."""
    if start >= end:
        raise ValueError(f"empty window: {start} .. {end}")
    return df.filter((F.col(col) >= F.lit(start)) & (F.col(col) < F.lit(end)))


def merge_upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], version: str | None, strict: bool = True, delete_missing: bool = False) -> DataFrame:
    """The target after an upsert: a source row replaces the target's if its version is newer (strict), or not older.

    Without a version every match is replaced. The source is first cut to its latest row of each key; of those that tie (all,
    where there is no version) the one with the largest hash of its values is taken, so reruns agree. One shuffle by the
    keys serves the deduplication and the full join. delete_missing drops target rows that the source lacks.
    """
    columns = target.columns
    order = [F.col(version).desc_nulls_last()] if version else []
    fresh = latest_by(source.select(*columns), keys, [*order, F.xxhash64(*columns).desc()])
    on = None
    for k in keys:
        on = (F.col(f"s.{k}") == F.col(f"t.{k}")) if on is None else on & (F.col(f"s.{k}") == F.col(f"t.{k}"))
    s_there, t_there = F.col("s.__s").isNotNull(), F.col("t.__t").isNotNull()
    joined = fresh.withColumn("__s", F.lit(1)).alias("s").join(target.withColumn("__t", F.lit(1)).alias("t"), on, "full")
    newer = F.lit(True)
    if version:
        a, b = F.col(f"s.{version}"), F.col(f"t.{version}")
        newer = F.coalesce(a > b if strict else a >= b, F.lit(False))
    take = s_there & (~t_there | newer)
    if delete_missing:
        joined = joined.filter(s_there)
    return joined.select(*[F.when(take, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in columns])


def soft_delete(target: DataFrame, gone: DataFrame, keys: Sequence[str], at: Column, column: str = "deleted_at") -> DataFrame:
    """The target with the time of deletion on rows whose keys are in `gone`; a row that is deleted already keeps its time, and one whose key is null stays."""
    there = gone.select(*keys).distinct().withColumn("__gone", F.lit(True))
    return target.join(there, list(keys), "left").withColumn(column, F.coalesce(column, F.when(F.col("__gone"), at))).select(*target.columns)


def merge_append(target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows to append: the first source row of each key that the target lacks."""
    return latest_by(source, keys, order).join(target.select(*keys), list(keys), "left_anti")


def current_state(events: DataFrame, key: str, op: str = "__op", ts: str = "__source_ts_ms", lsn: str = "__lsn", arrived: str | None = None) -> DataFrame:
    """The latest event of each key, unless that is a delete. Ranking comes before the filter, so nothing resurrects."""
    order = [F.expr(f"try_cast({ts} as bigint)").desc_nulls_last(), F.expr(f"try_cast({lsn} as bigint)").desc_nulls_last()]
    if arrived:
        order.append(F.col(arrived).desc_nulls_last())
    return latest_by(events, [key], order).filter(F.coalesce(F.col(op).cast("string"), F.lit("")) != "d")


def current_view(events: DataFrame, key: str, partition_time: Column, zone: str = ZONE, **names: str) -> DataFrame:
    """The current state by key, with the partition that each row came in: its time (UTC) and its hour on a zone's clock. Of changes that tie, the one of the later partition counts."""
    hour = format_local(F.col("_bq_partition_time"), "yyyy-MM-dd HH:00:00", zone)
    return current_state(events.withColumn("_bq_partition_time", partition_time), key, arrived="_bq_partition_time", **names).withColumn("_load_hour_jakarta", hour)


def scd2_apply(target: DataFrame, source: DataFrame, key: str, updated_at: str, now: Column) -> DataFrame:
    """A history after a snapshot of the source: columns of the source, scd_id, valid_from, valid_to.

    Open rows whose source has a newer updated_at close at that time; open rows that the source lacks close now; new and
    changed rows open at their updated_at. One full join of the open rows with the source does all of it.
    """
    columns = source.columns
    open_rows, closed = target.filter("valid_to is null"), target.filter("valid_to is not null")
    both = open_rows.withColumn("_t", F.lit(1)).alias("t").join(source.withColumn("_s", F.lit(1)).alias("s"), F.col(f"t.{key}") == F.col(f"s.{key}"), "full")
    changed = F.col("t._t").isNotNull() & F.col("s._s").isNotNull() & (F.col(f"s.{updated_at}") > F.col(f"t.{updated_at}"))
    old = F.struct(
        *[F.col(f"t.{c}").alias(c) for c in columns], F.col("t.scd_id").alias("scd_id"), F.col("t.valid_from").alias("valid_from"),
        F.when(changed, F.col(f"s.{updated_at}")).when(F.col("s._s").isNull(), now).alias("valid_to"),
    )
    new = F.struct(
        *[F.col(f"s.{c}").alias(c) for c in columns], surrogate_key(F.col(f"s.{key}"), F.col(f"s.{updated_at}")).alias("scd_id"),
        F.col(f"s.{updated_at}").alias("valid_from"), F.when(F.lit(False), F.col(f"s.{updated_at}")).alias("valid_to"),
    )
    kept = F.array_compact(F.array(F.when(F.col("t._t").isNotNull(), old), F.when(F.col("t._t").isNull() | changed, new)))
    rows = both.select(F.explode(kept).alias("r")).select("r.*")
    return rows.unionByName(closed.select(*rows.columns))


def scd2_from_history(versions: DataFrame, key: str, ts: str) -> DataFrame:
    """valid_from and valid_to of each version, from the next version's time."""
    following = F.lead(ts).over(Window.partitionBy(key).orderBy(ts))
    return versions.withColumn("valid_from", F.col(ts)).withColumn("valid_to", following)


def as_of_join(facts: DataFrame, dim: DataFrame, key: str, at: Column, columns: Sequence[str], unit: str = "day", seen: DataFrame | None = None) -> DataFrame:
    """Facts with the dim's columns that were valid at a time: one row for each fact, null where none was.

    The half-open intervals [valid_from, valid_to) of a key don't overlap; an absent end is open. Facts and versions are swept
    together in the order of their times, and each fact takes the last version before it, so the work is that of one sort,
    however many versions a key has. The sweep is cut into the days (`unit`) of each key, so a key with many facts is many
    groups; the version that was valid at a day's start is carried into it as one more row. Facts without a key or a
    time match nothing, and are spread over groups of their own. Keys and times are read once more, to know the days: from
    the facts, or from `seen`, which holds them as well (where several joins follow each other, the facts before the first).
    """
    own, time, day = (F.col(c) for c in ("_key", "_at", "_day"))
    since = F.datediff(time.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    bucket = {"hour": since * 24 + F.hour(time), "day": since, "month": (F.year(time) * 12 + F.month(time)).cast("long")}[unit]
    version = F.struct(F.col("valid_to").alias("_to"), *columns)
    versions = dim.select(F.col(key).alias("_key"), F.col("valid_from").alias("_at"), version.alias("_v")).filter(own.isNotNull() & time.isNotNull()).withColumn("_day", bucket)
    kept = F.struct(*[F.col(c) for c in facts.columns])
    lost = -1 - F.pmod(F.xxhash64("_f"), F.lit(1 << 12)) - (1 << 40)
    asked = facts.select(F.col(key).alias("_key"), at.alias("_at"), kept.alias("_f")).withColumn("_day", F.when(own.isNotNull() & time.isNotNull(), bucket).otherwise(lost))
    # of versions that begin together all but one are empty intervals, which come first
    ends = F.struct(time, F.col("_v._to").isNull(), F.col("_v._to"))
    last = versions.groupBy("_key", "_day").agg(F.max_by("_v", ends).alias("_v"))
    known = (facts if seen is None else seen).select(F.col(key).alias("_key"), at.alias("_at")).filter(own.isNotNull() & time.isNotNull())
    days = known.select("_key", bucket.alias("_day")).distinct().select("*", F.lit(None).cast(versions.schema["_v"].dataType).alias("_v"))
    before = Window.partitionBy("_key").orderBy(day, F.col("_v").isNull().desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = last.unionByName(days).withColumn("_c", F.last("_v", ignorenulls=True).over(before)).filter(F.col("_v").isNull() & F.col("_c").isNotNull())
    carried = carried.select("_key", F.lit(None).cast(versions.schema["_at"].dataType).alias("_at"), F.col("_c").alias("_v"), "_day")
    swept = asked.unionByName(versions.unionByName(carried), allowMissingColumns=True)
    order = [time.asc_nulls_first(), F.col("_f").isNotNull(), F.col("_v._to").asc_nulls_last()]
    found = swept.withColumn("_v", F.last("_v", ignorenulls=True).over(Window.partitionBy("_key", "_day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("_f").isNotNull())
    there = own.isNotNull() & (F.col("_v._to").isNull() | (time < F.col("_v._to")))
    return found.select("_f.*", *[F.when(there, F.col(f"_v.{c}")).alias(c) for c in columns])


#: Most versions of a key that are held beside it as one row (`as_of_piles`).
FEW = 64


def version_counts(dim: DataFrame, key: str) -> tuple[int, int]:
    """How many keys a dim has, and how many versions the key with most; one job over two columns."""
    there = dim.filter(F.col(key).isNotNull() & F.col("valid_from").isNotNull())
    keys, most = there.groupBy(key).count().agg(F.count(F.lit(1)), F.max("count")).first()
    return keys, most or 0


def as_of_piles(facts: DataFrame, dim: DataFrame, key: str, at: Column, columns: Sequence[str], small: bool = False) -> DataFrame:
    """As `as_of_join`, for dims whose keys have few versions: the versions of a key are one row, and facts are joined on the key alone.

    No days of keys are needed, and nothing is carried into them. With `small` the dim is broadcast, and facts stay where they are.
    """
    begin, end, new = F.col("valid_from"), F.col("valid_to"), F.col("_v")
    version = F.struct(begin.alias("_from"), end.isNull().alias("_open"), end.alias("_to"), *columns)
    piles = dim.filter(F.col(key).isNotNull() & begin.isNotNull()).select(F.col(key).alias("_dim"), version.alias("_v")).groupBy("_dim").agg(F.collect_list("_v").alias("_vs"))
    found = facts.join(F.broadcast(piles) if small else piles, F.col(key) == F.col("_dim"), "left").withColumn("_v", F.array_max(F.filter("_vs", lambda v: v["_from"] <= at)))
    there = new["_open"] | (at < new["_to"])
    return found.select(*[facts[c] for c in facts.columns], *[F.when(there, new[c]).alias(c) for c in columns])

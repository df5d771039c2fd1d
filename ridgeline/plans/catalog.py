"""Queries on the driver's tables by name, each with equivalent SQL in ridgeline.plans.oracle."""

from __future__ import annotations

import atexit
import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ridgeline.functions import expressions as X
from ridgeline.functions.schema import TABLES, TableConfig, parse_schema
from ridgeline.operators import history as H
from ridgeline.operators import quality as Q
from ridgeline.operators.evolve import align
from ridgeline.operators.funnel import funnel_steps
from ridgeline.operators.incremental import lookback_from_clock, lookback_from_max, run_model
from ridgeline.operators.store import Staged, Store, run_statements, shared_folder
from ridgeline.plans import oracle
from ridgeline.sources import connectors as C

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f: Callable) -> Callable:
    _QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _status() -> Column:
    """The status of an order as a ride's."""
    return F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "CANCELLED").otherwise("REQUESTED")


def _rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rides: city from the customer's nation, service from the priority."""
    orders, customers, nations = (_read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return (
        orders.join(customers, orders["o_custkey"] == customers["c_custkey"], "left")
        .join(nations, customers["c_nationkey"] == nations["n_nationkey"], "left")
        .select("o_orderkey", "o_custkey", "c_mktsegment", F.col("n_name").alias("city_code"), F.col("o_orderpriority").alias("service_type"), _status().alias("ride_status"), "o_totalprice", F.to_date("o_orderdate").alias("metric_date"))
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as change records of users."""
    op = F.when(F.col("event_type") == "error", "d").when(F.col("event_type") == "signup", "c").otherwise("u")
    return _read(spark, sf_dir, "events").select("*", op.alias("__op"), F.col("event_id").alias("__lsn"), F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("__source_ts_ms"))


# projections, filters, scalar functions


@_query
def p_stage_ride(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    kind = F.upper("event_type")
    return e.select(
        "event_id", kind.alias("event_type"), X.local_date(F.col("ts")).alias("local_day"), X.local_hour(F.col("ts")).alias("local_hour"), X.is_weekend(F.col("ts")).alias("is_weekend"),
        X.is_peak(F.col("ts")).alias("is_peak_hour"), (F.col("event_type") == "purchase").alias("is_purchase"), F.col("value").isNull().alias("is_deleted"), F.to_date("ts").alias("utc_day"),
    )


@_query
def p_minutes_between(spark, sf_dir):
    o, li = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "lineitem")
    j = o.join(li, o["o_orderkey"] == li["l_orderkey"])
    return j.select("o_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", X.minutes_between(F.col("o_orderdate"), F.col("l_shipdate")).alias("minutes"))


@_query
def p_lifecycle_outcome(spark, sf_dir):
    outcome = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "cancelled").otherwise("incomplete")
    return _read(spark, sf_dir, "orders").filter(~(F.col("o_totalprice") < 1000)).select("o_orderkey", outcome.alias("lifecycle_outcome"))


@_query
def p_safe_divide(spark, sf_dir):
    li = _read(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.safe_divide(F.col("l_extendedprice"), F.col("l_discount")).alias("ratio"), F.nullif(F.col("l_tax"), F.lit(0.0)).alias("tax_or_null"))


@_query
def p_surrogate_key(spark, sf_dir):
    c = _read(spark, sf_dir, "customer")
    maybe = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return c.select("c_custkey", X.surrogate_key(F.col("c_custkey")).alias("sk_one"), X.surrogate_key(F.col("c_custkey"), F.col("c_nationkey")).alias("sk_two"), X.surrogate_key(F.col("c_custkey"), maybe).alias("sk_null"))


@_query
def p_try_cast_op(spark, sf_dir):
    e = _events(spark, sf_dir)
    maybe = F.when(F.col("event_id") % 5 != 0, F.col("__op"))
    return e.filter(F.coalesce(maybe, F.lit("")) != "d").select("event_id", F.expr("try_cast(case when event_id % 7 = 0 then 'not a number' else cast(__lsn as string) end as bigint)").alias("lsn"), maybe.alias("op"))


@_query
def p_hour_label(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    return e.select("event_id", F.expr("concat(substring(cast(ts + interval 7 hours as string), 1, 13), ':00:00')").alias("load_hour"), F.to_date(F.trunc(F.to_date("ts"), "month")).alias("month_start"))


@_query
def p_window_extract(spark, sf_dir):
    e = H.in_window(_read(spark, sf_dir, "events"), "ts", dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 15))
    return H.latest_by(e, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "event_type", "value", F.lit("ride_ops_pg").alias("_source_system"))


@_query
def p_json_props(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@_query
def p_union_ctes(spark, sf_dir):
    """Counts of three filters, one row each: one scan with three sums, turned into rows."""
    counts = _read(spark, sf_dir, "orders").agg(*[F.count_if(F.col("o_orderstatus") == s).alias(s) for s in "FOP"])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("n")) for s in "FOP"])).alias("r")).select("r.*")


# deduplication


@_query
def d_latest_fare(spark, sf_dir):
    order = [F.col(c).desc() for c in ("l_linenumber", "l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey")]
    return H.latest_by(_read(spark, sf_dir, "lineitem"), ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@_query
def d_latest_composite(spark, sf_dir):
    order = [F.col(c).desc() for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")]
    return H.latest_by(_read(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], order).select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@_query
def d_cdc_current(spark, sf_dir):
    return H.current_view(_events(spark, sf_dir), "user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz")).select("user_id", "event_id", "event_type", "value", "__op", "_bq_partition_time", "_load_hour_jakarta")


# joins


@_query
def j_financials(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "ride_id")
    fares = d_latest_fare(spark, sf_dir).select(F.col("l_orderkey").alias("ride_id"), F.col("l_extendedprice").alias("total_fare"), "l_partkey")
    parts = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    riders = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return orders.join(fares, "ride_id", "left").join(parts, "l_partkey", "left").join(riders, "o_custkey", "left").select("ride_id", "o_custkey", "c_name", "total_fare", "p_brand")


@_query
def j_full_feedback(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    order = [F.col("ts").desc(), F.col("event_id").desc()]
    reviews = H.latest_by(e.filter("event_type = 'purchase' and user_id % 3 <> 0"), ["user_id"], order).select("user_id", F.col("event_id").alias("review_id"), F.col("ts").alias("reviewed_at"))
    tickets = H.latest_by(e.filter("event_type = 'error' and user_id % 2 = 0"), ["user_id"], order).select("user_id", F.col("event_id").alias("ticket_id"), F.col("ts").alias("opened_at"))
    return reviews.join(tickets, "user_id", "full").select("user_id", "review_id", "ticket_id", X.minutes_between(F.col("opened_at"), F.col("reviewed_at")).alias("minutes"))


@_query
def j_scd2_asof(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    dim = H.scd2_from_history(e.select("user_id", "ts", "event_type"), "user_id", "ts").select("user_id", "valid_from", "valid_to", F.col("event_type").alias("state"), X.surrogate_key(F.col("user_id"), F.col("event_type")).alias("state_sk"))
    facts = e.filter("event_id % 3 = 0").select("event_id", "user_id", "ts", "value")
    at = F.coalesce(F.when(F.col("value") > 50, F.col("ts") + F.expr("interval 90 minutes")), F.col("ts") - F.expr("interval 1 day"))
    return H.as_of_join(facts, dim, "user_id", at, ["state", "state_sk"]).select("event_id", "user_id", "state", "state_sk")


@_query
def j_append_anti(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey")
    seen = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    return H.merge_append(seen, o, ["k"], [F.col("o_custkey")]).select("k", "o_custkey")


@_query
def j_inner_promo(spark, sf_dir):
    li, p = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "part")
    return li.join(p, (li["l_partkey"] == p["p_partkey"]) & (li["l_quantity"] > 30) & (p["p_size"] < 20)).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), X.exact_sum(F.col("l_extendedprice")).alias("revenue"))


# merges and history


def _merge_sides(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("version"))
    target = o.filter("o_orderkey % 2 = 0")
    shift = F.expr("date_add(version, cast(o_orderkey % 3 as int) - 1)")
    source = o.filter("o_orderkey % 4 <> 2").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), shift.alias("version"))
    return target, source


@_query
def m_upsert_gt(spark, sf_dir):
    return H.merge_upsert(*_merge_sides(spark, sf_dir), ["o_orderkey"], "version", strict=True)


@_query
def m_upsert_ge(spark, sf_dir):
    return H.merge_upsert(*_merge_sides(spark, sf_dir), ["o_orderkey"], "version", strict=False)


@_query
def m_upsert_always(spark, sf_dir):
    return H.merge_upsert(*_merge_sides(spark, sf_dir), ["o_orderkey"], None)


@_query
def m_upsert_composite(spark, sf_dir):
    li = _read(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_shipdate").alias("version"), F.count(F.lit(1)).alias("n"))
    source = li.filter("l_partkey % 2 = 1").withColumn("n", F.col("n") + 10)
    return H.merge_upsert(li.filter("l_suppkey % 3 <> 0"), source, ["l_partkey", "l_suppkey"], "version", strict=False)


@_query
def m_append(spark, sf_dir):
    target, source = _merge_sides(spark, sf_dir)
    return target.unionByName(H.merge_append(target, source, ["o_orderkey"], [F.col("version").desc()]))


@_query
def m_hard_delete(spark, sf_dir):
    return H.merge_upsert(*_merge_sides(spark, sf_dir), ["o_orderkey"], "version", strict=True, delete_missing=True)


@_query
def m_scd2_apply(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.lit(dt.date(2024, 1, 1)).alias("updated_at"))
    first = c.filter("c_custkey % 10 <> 9")
    target = first.withColumn("scd_id", X.surrogate_key(F.col("c_custkey"), F.col("updated_at"))).withColumn("valid_from", F.col("updated_at")).withColumn("valid_to", F.lit(None).cast("date"))
    changed = F.when(F.col("c_custkey") % 4 == 0, F.lit(dt.date(2024, 2, 1))).otherwise(F.col("updated_at"))
    source = c.filter("c_custkey % 7 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), changed.alias("updated_at"))
    return H.scd2_apply(target, source, "c_custkey", "updated_at", F.lit(dt.date(2024, 3, 1)))


@_query
def m_schema_evolve(spark, sf_dir):
    """A table whose columns are renamed, widened, dropped and added again between loads, with no row written again."""
    from ridgeline.operators.identity import Columns

    o, table = _read(spark, sf_dir, "orders"), Columns(_scratch(spark), "orders")
    price = F.col("o_totalprice")
    table.create(o.filter("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_custkey").cast("int").alias("customer"), "o_orderstatus", price.cast("decimal(12,2)").alias("price"), F.lit("old").alias("note")))
    table.rename("o_orderstatus", "status")
    table.drop("note")
    later = o.filter("o_orderkey % 2 = 1").select("o_orderkey", F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"), price.cast("decimal(18,4)").alias("price"), F.col("o_orderpriority").alias("note"))
    table.sync(later.schema)
    table.append(later)
    return table.read().withColumn("price", F.col("price").cast("double"))


@_query
def m_soft_delete(spark, sf_dir):
    """Customers without an order are marked as deleted, twice: the first time stays."""
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    bought = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    idle = c.join(bought, "c_custkey", "left_anti")
    once = H.soft_delete(c, idle, ["c_custkey"], F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'"))
    return H.soft_delete(once, idle.unionByName(c.filter("c_custkey % 10 = 0")), ["c_custkey"], F.expr("TIMESTAMP_NTZ '2024-03-01 00:00:00'"))


@_query
def m_kept_snapshots(spark, sf_dir):
    """A history of customers over three runs: as they were, some changed or gone, and some of those changed again or back."""
    from ridgeline.operators.snapshots import snapshot

    store, c = _scratch(spark), _read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    for run in (0, 1, 2):
        turned, gone = (F.expr(f"c_custkey % {n} = 1") for n in (4 + run, 9 + run))
        at = F.when(turned, F.lit(dt.date(2024, 1 + run, 1))).otherwise(F.lit(dt.date(2024, 1, 1)) if run < 2 else F.expr("if(c_custkey % 5 = 1, date'2024-02-01', date'2024-01-01')"))
        state = c.filter(~gone).select("c_custkey", F.when(turned, F.concat("c_mktsegment", F.lit(str(run)))).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), at.alias("updated_at"))
        out = snapshot(store, "customers", state, "c_custkey", "updated_at", F.lit(dt.date(2024, 1 + run, 20)))
    return out


@_query
def q_gated_build(spark, sf_dir):
    """A table whose checks are counted as it is written: the second build fails them, so the first stays."""
    from ridgeline.operators.store import ChecksFailed

    store, o = _scratch(spark), _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    checks = {"not_null_status": F.col("o_orderstatus").isNull(), "accepted_status": ~F.col("o_orderstatus").isin("F", "O", "P"), "price_between": Q.outside("o_totalprice", 0, 10**9)}
    store.replace("orders", o, checks=checks)
    try:
        store.replace("orders", o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 != 0, F.when(F.col("o_orderkey") % 10 < 3, "X").otherwise(F.col("o_orderstatus")))), checks=checks)
        failures = {}
    except ChecksFailed as e:
        failures = e.failures
    return store.read("orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), *[F.lit(failures.get(name, 0)).cast("bigint").alias(name) for name in checks])


@_query
def m_schema_sync(spark, sf_dir):
    n = _read(spark, sf_dir, "nation")
    newer = n.filter("n_nationkey >= 10").withColumn("n_comment", F.lower("n_name"))
    old, new = align(n.filter("n_nationkey < 10"), newer)
    return old.unionByName(new)


# aggregates


@_query
def a_city_service(spark, sf_dir):
    r = _rides(spark, sf_dir)
    done, gone = F.col("ride_status") == "COMPLETED", F.col("ride_status") == "CANCELLED"
    fare = F.when(done, F.col("o_totalprice"))
    out = r.groupBy("metric_date", "city_code", "service_type").agg(
        F.count_distinct("o_orderkey").alias("requested_rides"), X.flag_count(done).alias("completed_rides"), X.flag_count(gone).alias("cancelled_rides"),
        X.exact_sum(F.coalesce(fare, F.lit(0.0))).alias("gross_revenue"), X.exact_sum(fare).alias("_fares"), F.count(fare).alias("_n"),
    )
    return out.withColumns({
        "completion_rate": X.safe_divide(F.col("completed_rides"), F.col("requested_rides")),
        "cancellation_rate": X.safe_divide(F.col("cancelled_rides"), F.col("requested_rides")),
        "avg_fare": X.safe_divide(F.col("_fares"), F.col("_n")),
    }).drop("_fares", "_n")


@_query
def a_payment_method(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    c = _read(spark, sf_dir, "customer").filter("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    j = o.join(c, "o_custkey", "left")
    return j.groupBy(F.to_date(F.trunc(F.to_date("o_orderdate"), "month")).alias("metric_month"), F.coalesce("c_mktsegment", F.lit("UNKNOWN")).alias("method_code")).agg(
        F.count(F.lit(1)).alias("payment_attempts"), X.flag_count(F.col("o_orderstatus") == "F").alias("paid_payments"), X.safe_divide(X.flag_count(F.col("o_orderstatus") == "F"), F.count(F.lit(1))).alias("success_rate"), X.exact_sum(F.col("o_totalprice")).alias("amount")
    )


@_query
def a_refunds(spark, sf_dir):
    li = _read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    cents = F.col("l_extendedprice").cast("decimal(18,2)")
    return li.groupBy(F.to_date("l_shipdate").alias("metric_date"), "l_linestatus").agg(F.count(F.lit(1)).alias("refund_count"), F.sum(cents).cast("double").alias("refund_amount"), X.safe_divide(F.sum(cents), F.count(F.lit(1))).alias("avg_refund"))


@_query
def a_driver_perf(spark, sf_dir):
    li, s = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "supplier")
    j = li.join(s.filter("s_acctbal > 0"), li["l_suppkey"] == s["s_suppkey"], "left").filter(F.col("s_suppkey").isNotNull())
    return j.groupBy("s_suppkey", "l_returnflag").agg(
        F.count(F.lit(1)).alias("assigned"), X.flag_count(F.col("l_linestatus") == "F").alias("finished"), X.safe_divide(X.flag_count(F.col("l_linestatus") == "F"), F.count(F.lit(1))).alias("rate"),
        X.exact_sum(F.coalesce("l_extendedprice", F.lit(0.0))).alias("earning"), F.min("l_quantity").alias("least_quantity"), F.max("l_quantity").alias("most_quantity"),
    )


@_query
def a_promo_perf(spark, sf_dir):
    li, p = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "part")
    j = li.join(p, li["l_partkey"] == p["p_partkey"], "left").filter(F.col("p_brand").isNotNull())
    off = F.col("l_extendedprice") * F.col("l_discount")
    return j.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("promo_rides"), X.exact_sum(F.col("l_extendedprice")).alias("revenue"), X.safe_divide(X.exact_sum(F.col("l_extendedprice")), F.nullif(X.exact_sum(off, 4), F.lit(0.0))).alias("revenue_per_discount"))


_KINDS = ("click", "error", "purchase", "signup", "view")


def _user_bitmaps(spark, sf_dir) -> DataFrame:
    """Bitmaps of each day's users, of all and of each type of event."""
    from ridgeline.operators.bitmaps import id_bitmaps

    return id_bitmaps(_read(spark, sf_dir, "events"), {"metric_date": F.to_date("ts")}, "user_id", {"users": F.lit(True), **{f"{t}_users": F.col("event_type") == t for t in _KINDS}})


@_query
def a_multi_distinct(spark, sf_dir):
    from ridgeline.operators.bitmaps import distinct_counts

    return distinct_counts(_user_bitmaps(spark, sf_dir), ["metric_date"], ["users", *(f"{t}_users" for t in _KINDS)])


@_query
def a_weekly_distinct(spark, sf_dir):
    """Users of weeks, from the days' bitmaps."""
    from ridgeline.operators.bitmaps import distinct_counts, united

    names = ["users", *(f"{t}_users" for t in _KINDS)]
    return distinct_counts(united(_user_bitmaps(spark, sf_dir), {"week": F.to_date(F.date_trunc("week", "metric_date"))}, names), ["week"], names)


@_query
def a_global(spark, sf_dir):
    return _read(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.max("o_orderkey"), F.lit(0)).alias("top_key"), F.min(F.to_date("o_orderdate")).alias("first_day"), F.max(F.to_date("o_orderdate")).alias("last_day"))


# windows


@_query
def w_funnel(spark, sf_dir):
    names = ("view", "click", "signup", "purchase")
    e = _read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("metric_date")).agg(*[X.flag_count(F.col("event_type") == n).alias(n) for n in names])
    return funnel_steps(e, ["metric_date"], [(n, f"{k:02} {n}") for k, n in enumerate(names, 1)])


@_query
def w_pct_of_total(spark, sf_dir):
    g = _read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    # five priorities: the unpartitioned window stands on grouped rows
    return g.select("o_orderpriority", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))), 2).cast("double").alias("pct"))


@_query
def t_top1_limit(spark, sf_dir):
    return _read(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(1).select("o_orderkey", "o_totalprice")


# incremental models


@_query
def i_lookback_max(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    built = o.filter("o_orderkey % 2 = 0")
    return lookback_from_max(o, "day", built, "day", days=3).select("o_orderkey", "day")


@_query
def i_lookback_clock(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    return lookback_from_clock(o, "day", dt.date(2001, 7, 20), days=7).select("o_orderkey", "day")


@_query
def i_insert_overwrite(spark, sf_dir):
    """A model's second run replaces the months of its rows in its table."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.to_date(F.trunc(F.to_date("o_orderdate"), "month")).alias("month"))
    store = _scratch(spark)
    run_model(store, "orders", o, "insert_overwrite", partition="month")
    return run_model(store, "orders", o.filter("month >= date'2001-01-01'").withColumn("o_totalprice", F.col("o_totalprice") * 2), "insert_overwrite", partition="month")


@_query
def s_dim_date(spark, sf_dir):
    from ridgeline.sources.spine import date_dimension

    return date_dimension(spark)


# checks


@_query
def q_failures(spark, sf_dir):
    o, li, n, e, lb, d = (_read(spark, sf_dir, t) for t in ("orders", "lineitem", "nation", "events", "labels", "documents"))
    # checks of single rows are sums of one scan a table; the others need keys to meet
    rows = {
        e: {"not_null_value": F.col("value").isNull()},
        o: {"accepted_status": F.col("o_orderstatus").isNotNull() & ~F.col("o_orderstatus").isin("F", "O")},
        li: {"between_quantity": Q.outside("l_quantity", 2, 49), "strictly_discount": Q.outside("l_discount", 0, 0.1, strictly=True)},
    }
    keyed = {
        "unique_orders": Q.unique(o, "o_orderkey"),
        "unique_custkey": Q.unique(o, "o_custkey"),
        "relationships_orders": Q.relationships(o, "o_orderkey", li, "l_orderkey"),
        "relationships_labels": Q.relationships(lb, "doc_id", d, "doc_id", where="toxic = 1"),
        "unique_combo_lines": Q.unique_combination(li, ["l_orderkey", "l_linenumber"]),
        "unique_nation": Q.unique(n, "n_name"),
    }
    out = None
    for row in (*(Q.failures(df, checks) for df, checks in rows.items()), *(x.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(name).alias("check_name"), "failures") for name, x in keyed.items())):
        out = row if out is None else out.unionByName(row)
    return out


@_query
def v_date_coverage(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("rides"))
    return o.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("days"), (F.datediff(F.max("day"), F.min("day")) + 1 - F.count(F.lit(1))).cast("bigint").alias("missing_days"))


@_query
def v_hour_demand(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    return e.groupBy(X.local_hour(F.col("ts")).alias("hour"), X.is_peak(F.col("ts")).alias("is_peak")).agg(F.count(F.lit(1)).alias("rides")).orderBy("hour")


@_query
def v_promo_usage(spark, sf_dir):
    li, p = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "part")
    j = li.join(p, li["l_partkey"] == p["p_partkey"])
    return j.groupBy("p_brand").agg(F.count(F.lit(1)).alias("usages"), F.count_distinct("l_orderkey").alias("rides"), X.exact_sum(F.col("l_extendedprice")).alias("amount")).orderBy(F.col("usages").desc(), "p_brand")


@_query
def g_fares(spark, sf_dir):
    """The generator's fare rule in decimals: surge, tax of 11%, platform fee of 18%."""
    from ridgeline.sources.datagen import fare_columns

    o = _read(spark, sf_dir, "orders").withColumn("km", F.expr("cast((o_orderkey % 300) + 5 as decimal(10,2)) / 10")).withColumn("minutes", F.expr("cast((o_orderkey % 70) + 6 as decimal(10,2))"))
    surge = F.expr("cast(1 + (o_orderkey % 4) * 0.2 as decimal(6,2))")
    fares = fare_columns(F.col("km").cast("decimal(10,2)"), F.col("minutes"), surge)
    return o.select("o_orderkey", *[c.cast("double").alias(n) for n, c in fares.items()])


# streams


def _changes(batch: DataFrame) -> DataFrame:
    """Events as change records, as `_events` gives them."""
    op = F.when(F.col("event_type") == "error", "d").when(F.col("event_type") == "signup", "c").otherwise("u")
    return batch.select("*", op.alias("__op"), F.col("event_id").alias("__lsn"), F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("__source_ts_ms"))


def _event_stream(spark, sf_dir):
    from ridgeline.streaming.cdc import file_stream

    return file_stream(spark, f"{sf_dir}/events.parquet", _read(spark, sf_dir, "events").schema)


def _scratch(spark: SparkSession) -> Store:
    """A store of one query's own, which goes when the driver ends."""
    store = Store(spark, f"{shared_folder(spark)}/query-{uuid.uuid4().hex}")
    atexit.register(lambda: spark.sparkContext._jsc and store.drop(""))
    return store


@_query
def st_cdc_current(spark, sf_dir):
    from ridgeline.streaming.cdc import replay_stream

    return replay_stream(_event_stream(spark, sf_dir), "user_id", _changes).select("user_id", "event_id", "event_type", "value", "__op")


@_query
def st_state_current(spark, sf_dir):
    """The same state, kept in the state store of a stream that stops half-way and goes on from its checkpoint."""
    from ridgeline.streaming.cdc import file_stream, state_stream

    store, events = _scratch(spark), _read(spark, sf_dir, "events")
    folder, offsets = f"{store.root}/files", f"{store.root}/offsets"
    for part in (0, 1):
        events.filter(F.pmod(F.xxhash64("event_id"), F.lit(2)) == part).write.mode("append").parquet(folder)
        state = state_stream(file_stream(spark, f"{folder}/*.parquet", events.schema), store, "users", "user_id", _changes, offsets)
    return state.select("user_id", "event_id", "event_type", "value", "__op")


@_query
def st_upsert_sink(spark, sf_dir):
    """The same state through a table that batches of the stream are merged into; the last of them come twice."""
    from ridgeline.streaming.cdc import upsert_changes, upsert_sink, upserted

    store = _scratch(spark)
    upsert_sink(_event_stream(spark, sf_dir), store, "users", "user_id", _changes)
    upsert_changes(store, "users", _changes(_read(spark, sf_dir, "events").filter("event_id % 3 = 0")), "user_id")
    return upserted(store, "users").select("user_id", "event_id", "event_type", "value", "__op")


@_query
def st_bootstrap(spark, sf_dir):
    """The same state from a snapshot of the first half of the month and the stream, which holds those days again."""
    from ridgeline.streaming.cdc import bootstrap

    early = _read(spark, sf_dir, "events").filter(F.col("ts") < F.lit(dt.datetime(2024, 1, 16)))
    return bootstrap(early, _event_stream(spark, sf_dir), "user_id", _changes).select("user_id", "event_id", "event_type", "value", "__op")


@_query
def st_hour_buckets(spark, sf_dir):
    from ridgeline.streaming.cdc import hourly_sink

    return hourly_sink(_event_stream(spark, sf_dir)).groupBy("load_hour").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"))


@_query
def st_clock_folders(spark, sf_dir):
    """Rows in the folder of the hour at which they came (the clock stands still), whatever time they bear."""
    from ridgeline.streaming.cdc import SINKS, clock_sink

    rows = clock_sink(_event_stream(spark, sf_dir), SINKS["minio"], now=F.lit(dt.datetime(2024, 2, 29, 18, 30)).cast("timestamp_ntz"))
    return rows.groupBy(*[F.col(c).cast("bigint").alias(c) for c in ("year", "month", "day", "hour")]).agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@_query
def st_dead_letters(spark, sf_dir):
    """Events as JSON text, every tenth cut short: what parses, and what goes to the dead letters."""
    from ridgeline.streaming.cdc import dead_letter_sink

    text = F.to_json(F.struct("event_id", "user_id", "event_type"))
    spoilt = F.when(F.col("event_id") % 10 == 3, F.expr(f"substring({'to_json(struct(event_id, user_id, event_type))'}, 1, 12)")).when(F.col("event_id") % 10 == 4, F.lit(None)).otherwise(text)
    good, bad = dead_letter_sink(_event_stream(spark, sf_dir).select(spoilt.alias("value")), T.StructType.fromDDL("event_id long, user_id long, event_type string"), F.lit(dt.datetime(2024, 2, 1)).cast("timestamp_ntz"))
    kept = good.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))
    lost = bad.groupBy(F.element_at("headers", "error").alias("event_type")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("ids"))
    return kept.unionByName(lost)


@_query
def st_strict(spark, sf_dir):
    """Events as JSON text, parsed so that the first bad record would end the run; there is none."""
    from ridgeline.streaming.cdc import parse_strict

    text = _read(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "user_id", "event_type")).alias("value"))
    return parse_strict(text, T.StructType.fromDDL("event_id long, user_id long, event_type string"))


@_query
def st_envelope(spark, sf_dir):
    """Raw change envelopes, made of the events, as rows: a delete holds the row before it, and one without rows is dropped."""
    from ridgeline.streaming.cdc import flatten_envelope

    row = F.struct("event_id", "user_id", "event_type")
    e = _events(spark, sf_dir)
    raw = e.select(F.when(F.col("__op") == "d", F.when(F.col("event_id") % 4 != 0, row)).alias("before"), F.when(F.col("__op") != "d", row).alias("after"), F.col("__op").alias("op"), F.col("__source_ts_ms").alias("ts_ms"), F.struct(F.col("__lsn").alias("lsn")).alias("source"))
    return flatten_envelope(raw, "events")


# stores, statements, loads


@_query
def i_merge_store(spark, sf_dir):
    """Two runs of a model that is merged into its table, the second as an increment beside the first."""
    target, source = _merge_sides(spark, sf_dir)
    store = _scratch(spark)
    run_model(store, "orders", target, "merge", ["o_orderkey"])
    return run_model(store, "orders", source, "merge", ["o_orderkey"]).select("o_orderkey", "o_totalprice", "version")


@_query
def i_hour_load(spark, sf_dir):
    """Change files of some hours loaded into their partitions, one hour twice; an hour without files is skipped."""
    from ridgeline.operators.incremental import load_hour

    store, e = _scratch(spark), _events(spark, sf_dir).withColumn("hour", F.date_trunc("hour", F.col("ts")))
    for hour in (5, 6, 6, 7, 30):
        at = dt.datetime(2024, 1, 3) + dt.timedelta(hours=hour)
        load_hour(store, "events", e.filter(F.col("hour") == F.lit(at)) if hour < 24 else None, "hour")
    return store.read_partitions("events", "hour", F.col("hour") >= F.lit(dt.datetime(2024, 1, 3))).groupBy("hour").agg(F.count(F.lit(1)).alias("events"), F.sum("event_id").alias("ids")).select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "events", "ids")


@_query
def i_write_query(spark, sf_dir):
    """Two queries' rows in one table, partitioned and clustered; the second brings a column more."""
    store, o = _scratch(spark), _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    for _ in range(2):  # the second run takes the place of the first
        store.load("orders", o.filter("o_orderkey % 2 = 0"), partition=["o_orderstatus"], cluster=["o_totalprice"])
    store.load("orders", o.filter("o_orderkey % 2 = 1").withColumn("doubled", F.col("o_totalprice") * 2), "append", create=False, new_columns=True)
    return store.read("orders")


@_query
def i_clustered_ranges(spark, sf_dir):
    """Lines of a range of days and of parts, from files that were dealt by both."""
    from ridgeline.operators.clustering import cluster, read_ranges

    store, lines = _scratch(spark), _read(spark, sf_dir, "lineitem")
    cluster(store, "lines", lines, ["l_shipdate", "l_partkey"], 64)
    most = lines.agg(F.max("l_partkey")).first()[0]
    found = read_ranges(store, "lines", {"l_shipdate": (dt.datetime(1996, 1, 1), dt.datetime(1996, 4, 1)), "l_partkey": (most // 2, most // 2 + most // 20)})
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")


@_query
def i_catch_up(spark, sf_dir):
    """Change files of days loaded to make up for what is missing: some days are noted as loaded, one has no files, one fails at first."""
    from ridgeline.operators.catchup import catch_up, missing, note, notes
    from ridgeline.operators.incremental import load_hour

    store, e, day = _scratch(spark), _events(spark, sf_dir), dt.timedelta(days=1)
    first, last = (dt.datetime.combine(x, dt.time()) + k * day for k, x in enumerate(e.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()))
    files = f"{store.root}/changes"
    e.withColumn("day", F.to_date("ts")).filter(F.col("day") != F.lit((first + 4 * day).date())).repartition("day").write.partitionBy("day").parquet(files)
    note(store, [("events", first + k * day, "loaded", 1, None, first) for k in (1, 2, 9)])
    gaps, failed = missing(store, "events", first, last, day).count(), set()

    def load(at):
        if at == first + 6 * day and at not in failed:
            failed.add(at)
            raise OSError("the first try fails")
        load_hour(store, "events", spark.read.schema(e.schema).parquet(f"{files}/day={at:%Y-%m-%d}").withColumn("day", F.to_date(F.lit(at))), "day")

    for _ in range(2):  # the second run finds nothing to load
        became = catch_up(store, "events", first, last, day, lambda at: C.probe(spark, f"{files}/day={at:%Y-%m-%d}") == "ready", load, last)
    said = notes(store, "events").select(F.to_date("step").alias("day"), "status", F.col("tries").cast("bigint").alias("tries"))
    loaded = store.read("events").groupBy("day").agg(F.count(F.lit(1)).alias("events"), F.sum("event_id").alias("ids"))
    return said.join(loaded, "day", "left").withColumn("gaps", F.lit(gaps).cast("bigint")).withColumn("again", F.lit(len(became)).cast("bigint"))


@_query
def i_full_refresh(spark, sf_dir):
    """A model that was merged twice and is then built anew from other rows: nothing of the old ones is left."""
    store, o = _scratch(spark), _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    run_model(store, "orders", o.filter("o_orderkey % 2 = 0"), "merge", ["o_orderkey"])
    run_model(store, "orders", o.filter("o_orderkey % 3 = 0").withColumn("o_totalprice", F.lit(0.0)), "merge", ["o_orderkey"])
    return run_model(store, "orders", o.filter("o_orderkey % 4 <> 0"), "merge", ["o_orderkey"], full_refresh=True)


@_query
def i_create_absent(spark, sf_dir):
    """A declared table that is made if it isn't there, filled, and left alone when it is declared again."""
    store, o = _scratch(spark), _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    store.create("orders", o.schema)
    first = store.read("orders").count()
    store.load("orders", o, "empty")
    store.create("orders", o.schema)
    return store.read("orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.lit(first).cast("bigint").alias("before"))


@_query
def i_truncate_reset(spark, sf_dir):
    """Ids that a table gives next, before and after it is emptied."""
    store = _scratch(spark)
    store.replace("orders", _read(spark, sf_dir, "orders").select("o_orderkey"))
    before = store.next_id("orders", "o_orderkey")
    store.truncate("orders")
    return store.read("orders").agg(F.lit(before).cast("bigint").alias("next_before"), F.lit(store.next_id("orders", "o_orderkey")).cast("bigint").alias("next_after"), F.count(F.lit(1)).alias("rows_left"))


@_query
def s_statement_list(spark, sf_dir):
    """Statements in turn, with a temporary table that goes with them."""
    return run_statements(spark, [
        "CREATE TEMPORARY VIEW large AS SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000",
        "SELECT c_mktsegment, count(*) AS n, min(o_totalprice) AS least FROM large JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    ], {"orders": _read(spark, sf_dir, "orders"), "customer": _read(spark, sf_dir, "customer")})


@_query
def j_two_systems(spark, sf_dir):
    """One statement over tables of two systems (files here, a store there), written to a table of the second."""
    here, there = _read(spark, sf_dir, "orders"), _scratch(spark)
    there.replace("customer", _read(spark, sf_dir, "customer"))
    rows = run_statements(spark, ["SELECT o_orderkey, o_custkey, c_name, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'"], {"orders": here, "customer": there.read("customer")})
    with Staged(there, "copied", rows) as staged:
        there.replace("orders_named", staged, cluster=["c_nationkey"])
    return there.read("orders_named")


@_query
def c_change_files(spark, sf_dir):
    """Change files of two hours, the later with one more column, read as one table."""
    folder = f"{_scratch(spark).root}/changes"
    e = _events(spark, sf_dir).select("event_id", "user_id", "__op")
    e.filter("event_id % 2 = 0").write.parquet(f"{folder}/{C.cdc_path('cdc.public.events', dt.datetime(2024, 1, 1, 5))}")
    e.filter("event_id % 2 = 1").withColumn("extra", F.col("event_id") * 2).write.parquet(f"{folder}/{C.cdc_path('cdc.public.events', dt.datetime(2024, 1, 1, 6))}")
    return C.read_changes(spark, folder + "/raw/cdc/cdc.public.events").select("event_id", "user_id", "__op", "extra", F.col("hour").cast("bigint").alias("hour"))


@_query
def p_ingested(spark, sf_dir):
    """A window that was asked for by hand, in the source's clock (UTC+7), extracted with casts and metadata columns."""
    window = C.resolve_window({"window_start": "2024-01-08", "window_end": "2024-01-15"}, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), "Asia/Jakarta")
    config = TableConfig("events", ("user_id",), parse_schema("user_id:L! event_id:S event_type:S ts:T!"), window_col="ts", version_col="ts", source_zone="Asia/Jakarta", source_system="o'brien")
    return C.extract(_read(spark, sf_dir, "events"), config, window, dt.datetime(2024, 1, 20))


@_query
def p_zone_window(spark, sf_dir):
    """Days of a run (UTC) on New York's clock, over the start of its summer time, from clicks that bear that clock."""
    window = C.resolve_window(None, dt.datetime(2024, 3, 8), dt.datetime(2024, 3, 13), "America/New_York")
    clicks = H.in_window(_read(spark, sf_dir, "clicks"), "ts", *window)
    return clicks.select("click_id", "arrived_at", "client_id", "kind", X.to_utc(F.col("ts"), "America/New_York").alias("ts"), F.lit(C.partition_suffix(window[1], "America/New_York")).alias("upto"))


@_query
def i_ingest_merge(spark, sf_dir):
    """Three loads of payments (naive Jakarta times, versions not older win): a window, all days with later versions, and the window again."""
    from ridgeline.plans.ingest import bronze, ingest
    from ridgeline.plans.stand_in import StandIn

    store, config = _scratch(spark), replace(TABLES["payment_transaction"], unit="year")
    first = StandIn(spark, sf_dir)["payment_transaction"]
    later = first.withColumn("updated_at", F.col("updated_at") + F.expr("INTERVAL '1' DAY") * (F.col("ride_id") % 3 - 1)).withColumn("method_fee", F.lit(7).cast("decimal(38,9)"))
    window, now = (dt.datetime(1996, 1, 1), dt.datetime(1998, 1, 1)), dt.datetime(2024, 1, 1)
    for rows, span in ((first, window), (later, None), (first, window)):
        ingest(store, config, rows, span, now)
    return bronze(store, config).select("payment_transaction_id", "ride_id", "payment_status", F.col("method_fee").cast("double").alias("method_fee"), "updated_at", "_ingested_at", "_source_system")


@_query
def i_ingest_append(spark, sf_dir):
    """Three loads of status history, which only grows, by overlapping windows; and what the lineage says of them."""
    from ridgeline.plans.ingest import LINEAGE, bronze, ingest
    from ridgeline.plans.stand_in import StandIn

    store, config, source = _scratch(spark), TABLES["ride_status_history"], StandIn(spark, sf_dir)["ride_status_history"]
    for first, last in ((3, 10), (8, 15), (3, 10)):
        ingest(store, config, source, (dt.datetime(2024, 1, first), dt.datetime(2024, 1, last)), dt.datetime(2024, 2, 1), {"team": "Data Eng"})
    loads = store.read(LINEAGE).groupBy().agg(F.count(F.lit(1)).alias("loads"), F.max(F.element_at("labels", "table")).alias("label"))
    rows = bronze(store, config).groupBy("new_status").agg(F.count(F.lit(1)).alias("n"), F.min("ride_status_history_id").alias("first_id"), F.max("ride_status_history_id").alias("last_id"))
    return rows.withColumn("loads", F.lit(loads.first()["loads"])).withColumn("label", F.lit(loads.first()["label"]))


# more expressions


@_query
def p_time_formats(spark, sf_dir):
    """Text of a time on the clocks of two zones, truncated times, and a naive time of New York as UTC."""
    ts = F.col("ts")
    return _read(spark, sf_dir, "events").select(
        "event_id", X.format_local(ts, "yyyy-MM-dd HH:00:00").alias("jakarta_hour"), X.format_local(ts, "yyyy-MM-dd HH:mm", "America/New_York").alias("new_york"), X.to_utc(ts, "America/New_York").alias("from_new_york"), X.today("Asia/Jakarta", ts).alias("jakarta_day"),
        *[F.date_trunc(unit, ts).alias(f"{unit}_start") for unit in ("hour", "day", "month", "year")],
    )


@_query
def p_to_json(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"))).alias("payload"))


@_query
def p_clamp(spark, sf_dir):
    """A discount of a percentage up to a cap, and never more than the price."""
    li = _read(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.clamp(F.col("l_extendedprice") * F.col("l_discount"), F.lit(100.0), F.least(F.lit(2500.0), F.col("l_extendedprice"))).alias("discount"))


@_query
def d_latest_version(spark, sf_dir):
    """The latest version of each key by two keys of order alone."""
    order = [F.col("l_linenumber").desc(), F.col("l_shipdate").desc()]
    return H.latest_by(_read(spark, sf_dir, "lineitem"), ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_shipdate")


@_query
def d_cdc_arrival(spark, sf_dir):
    """Changes that came twice, the second time with another operation: of equal time and position the later arrival counts."""
    e = _events(spark, sf_dir)
    again = e.filter("event_id % 3 = 0").withColumn("__op", F.lit("d")).withColumn("arrived", F.lit(2))
    return H.current_state(e.withColumn("arrived", F.lit(1)).unionByName(again), "user_id", arrived="arrived").select("user_id", "event_id", "event_type", "__op", "arrived")


@_query
def a_averages(spark, sf_dir):
    """Means that leave nulls out."""
    li = _read(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag").agg(F.avg("l_linenumber").alias("mean_line"), F.avg(F.when(F.col("l_linestatus") == "F", F.col("l_linenumber"))).alias("mean_finished"), F.avg(F.when(F.col("l_linenumber") > 99, 1)).alias("mean_of_none"))


@_query
def t_seeded_sample(spark, sf_dir):
    """Ten suppliers at random, the same ones for the same seed."""
    return _read(spark, sf_dir, "supplier").orderBy(F.md5(F.concat(F.lit("42:"), F.col("s_suppkey").cast("string"))), "s_suppkey").limit(10).select("s_suppkey", "s_name")


# the generator's rules


@_query
def g_demand(spark, sf_dir):
    """Rides expected in each hour of 2026-01-01 to 2026-06-30, without noise."""
    from ridgeline.sources.datagen import HOURS, demand_expr, hour_expr

    days = spark.sql("SELECT d, h FROM (SELECT explode(sequence(date'2026-01-01', date'2026-06-30', interval 1 day)) AS d) LATERAL VIEW explode(sequence(0, 23)) AS h")
    return days.select(F.col("d").alias("day"), F.col("h").cast("bigint").alias("hour"), F.expr(f"({demand_expr('d')}) * ({hour_expr('d', 'h')}) / {sum(HOURS)}D").alias("share"))


@_query
def g_mix(spark, sf_dir):
    """Shares of cities, and of services in a city, by weekday and hour; and outcomes by context."""
    from ridgeline.sources.datagen import city_weights, context_flags, outcome_weights, service_weights

    e = _read(spark, sf_dir, "events").select("event_id", F.date_add(F.to_date("ts"), 0).alias("d"), F.hour("ts").alias("h"), F.expr("element_at(array('JKT', 'BDG', 'SBY'), cast(event_id % 3 as int) + 1)").alias("city"))
    flags = {name: F.expr(text) for name, text in context_flags("d", "h", "city", "(event_id % 100) / 100.0D", "(event_id % 37) / 37.0D").items()}
    mixed = e.select("*", *[F.expr(x).alias(f"share_{k.lower()}") for k, x in city_weights("d", "h").items()], *[F.expr(x).alias(f"share_{k.lower()}") for k, x in service_weights("d", "h", "city").items()], *[c.alias(k) for k, c in flags.items()])
    return mixed.select("event_id", "city", *[c for c in mixed.columns if c.startswith("share_")], *flags, *[F.expr(x).alias(f"weight_{k.lower()}") for k, x in outcome_weights("event_id % 10 > 6", "event_id % 20 > 16", "event_id % 4 = 0").items()])


def _models() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from ridgeline.plans.marts import MODELS, build

    return {f"model_{name}": (lambda spark, sf_dir, name=name: build(spark, sf_dir, name)) for name in MODELS}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**_QUERIES, **_models()}


def _model_sql() -> dict[str, str]:
    from ridgeline.plans.marts import MODELS
    from ridgeline.plans.model_sql import model_sql

    return {f"model_{name}": model_sql(name) for name in MODELS}


def oracle_sql() -> dict[str, str]:
    return {**oracle.sql(), **_model_sql()}

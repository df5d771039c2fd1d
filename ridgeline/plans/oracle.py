"""The catalogue's queries as SQL over the same tables."""

from __future__ import annotations

from ridgeline.plans.stand_in import VIEWS, as_sql
from ridgeline.sources.datagen import HOURS, city_weights, context_flags, demand_expr, hour_expr, outcome_weights, service_weights

_EVENTS = "(SELECT *, CASE WHEN event_type = 'error' THEN 'd' WHEN event_type = 'signup' THEN 'c' ELSE 'u' END AS __op, event_id AS __lsn, epoch_us(ts) // 1000 AS __source_ts_ms FROM events)"
_LOCAL = "(ts + INTERVAL 7 HOURS)"
_PEAK = f"(hour({_LOCAL}) BETWEEN 7 AND 9 OR hour({_LOCAL}) BETWEEN 17 AND 20)"
_NULL = "_dbt_utils_surrogate_key_null_"
_MERGE = """WITH o AS (SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS version FROM orders),
t AS (SELECT * FROM o WHERE o_orderkey % 2 = 0),
s AS (SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, CAST(version + CAST(o_orderkey % 3 - 1 AS INTEGER) AS DATE) AS version FROM o WHERE o_orderkey % 4 <> 2)
"""


def _sum(x: str, digits: int = 2) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,{digits}))) AS DOUBLE)"


def _upsert(take: str, join: str = "FULL") -> str:
    pick = ", ".join(f"CASE WHEN {take} THEN s.{c} ELSE t.{c} END AS {c}" for c in ("o_orderkey", "o_totalprice", "version"))
    return f"{_MERGE} SELECT {pick} FROM s {join} JOIN t ON s.o_orderkey = t.o_orderkey"


_SQL = {
    "p_stage_ride": f"""SELECT event_id, upper(event_type) AS event_type, CAST({_LOCAL} AS DATE) AS local_day, hour({_LOCAL}) AS local_hour, dayofweek({_LOCAL}) IN (0, 6) AS is_weekend,
      {_PEAK} AS is_peak_hour, event_type = 'purchase' AS is_purchase, value IS NULL AS is_deleted, CAST(ts AS DATE) AS utc_day FROM events""",
    "p_minutes_between": "SELECT o_orderkey, l_linenumber, l_partkey, l_extendedprice, date_sub('minute', o_orderdate, l_shipdate) AS minutes FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "p_lifecycle_outcome": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'cancelled' ELSE 'incomplete' END AS lifecycle_outcome FROM orders WHERE NOT (o_totalprice < 1000)",
    "p_safe_divide": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / nullif(l_discount, 0) AS ratio, nullif(l_tax, 0) AS tax_or_null FROM lineitem",
    "p_surrogate_key": f"""SELECT c_custkey, md5(CAST(c_custkey AS VARCHAR)) AS sk_one, md5(c_custkey || '-' || c_nationkey) AS sk_two,
      md5(c_custkey || '-' || coalesce(nullif(c_mktsegment, 'BUILDING'), '{_NULL}')) AS sk_null FROM customer""",
    "p_try_cast_op": f"""SELECT event_id, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'not a number' ELSE CAST(__lsn AS VARCHAR) END AS BIGINT) AS lsn, CASE WHEN event_id % 5 <> 0 THEN __op END AS op
      FROM {_EVENTS} WHERE coalesce(CASE WHEN event_id % 5 <> 0 THEN __op END, '') <> 'd'""",
    "p_hour_label": f"SELECT event_id, strftime({_LOCAL}, '%Y-%m-%d %H:00:00') AS load_hour, CAST(date_trunc('month', ts) AS DATE) AS month_start FROM events",
    "p_window_extract": """SELECT user_id, event_id, event_type, value, 'ride_ops_pg' AS _source_system FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
      FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15') WHERE rn = 1""",
    "p_json_props": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "p_union_ctes": "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1",
    "d_latest_fare": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber DESC, l_shipdate DESC, l_extendedprice DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1""",
    "d_latest_composite": """SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey
      ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS rn FROM lineitem) WHERE rn = 1""",
    "d_cdc_current": f"""SELECT user_id, event_id, event_type, value, __op FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY __source_ts_ms DESC, __lsn DESC) AS rn FROM {_EVENTS})
      WHERE rn = 1 AND coalesce(__op, '') <> 'd'""",
    "j_financials": """SELECT o_orderkey AS ride_id, o_custkey, c_name, f.l_extendedprice AS total_fare, p_brand FROM orders LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber DESC, l_shipdate DESC, l_extendedprice DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1) f ON o_orderkey = l_orderkey
      LEFT JOIN part ON f.l_partkey = p_partkey LEFT JOIN customer ON o_custkey = c_custkey""",
    "j_full_feedback": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events),
      r AS (SELECT * FROM e WHERE rn = 1 AND event_type = 'purchase' AND user_id % 3 <> 0), t AS (SELECT * FROM e WHERE rn = 1 AND event_type = 'error' AND user_id % 2 = 0)
      SELECT coalesce(r.user_id, t.user_id) AS user_id, r.event_id AS review_id, t.event_id AS ticket_id, date_sub('minute', t.ts, r.ts) AS minutes FROM r FULL JOIN t ON r.user_id = t.user_id""",
    "j_scd2_asof": """WITH d AS (SELECT user_id, ts AS f, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS t, event_type FROM events),
      x AS (SELECT event_id, user_id, CASE WHEN value > 50 THEN ts + INTERVAL 90 MINUTES ELSE ts - INTERVAL 1 DAY END AS at_ts FROM events WHERE event_id % 3 = 0)
      SELECT event_id, x.user_id, event_type AS state, md5(d.user_id || '-' || event_type) AS state_sk FROM x
      LEFT JOIN d ON x.user_id = d.user_id AND at_ts >= f AND at_ts < coalesce(t, TIMESTAMP '9999-12-31')""",
    "j_append_anti": "SELECT o_orderkey AS k, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "j_inner_promo": f"SELECT p_brand, count(*) AS n, {_sum('l_extendedprice')} AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey AND l_quantity > 30 AND p_size < 20 GROUP BY 1",
    "m_upsert_gt": _upsert("s.o_orderkey IS NOT NULL AND (t.o_orderkey IS NULL OR s.version > t.version)"),
    "m_upsert_ge": _upsert("s.o_orderkey IS NOT NULL AND (t.o_orderkey IS NULL OR s.version >= t.version)"),
    "m_upsert_always": _upsert("s.o_orderkey IS NOT NULL"),
    "m_hard_delete": _upsert("t.o_orderkey IS NULL OR s.version > t.version", "LEFT"),
    "m_upsert_composite": """WITH a AS (SELECT l_partkey, l_suppkey, max(l_shipdate) AS version, count(*) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT * FROM a WHERE l_suppkey % 3 <> 0),
      s AS (SELECT l_partkey, l_suppkey, version, n + 10 AS n FROM a WHERE l_partkey % 2 = 1)
      SELECT coalesce(s.l_partkey, t.l_partkey) AS l_partkey, coalesce(s.l_suppkey, t.l_suppkey) AS l_suppkey, coalesce(s.version, t.version) AS version, coalesce(s.n, t.n) AS n
      FROM s FULL JOIN t ON s.l_partkey = t.l_partkey AND s.l_suppkey = t.l_suppkey""",
    "m_append": f"{_MERGE} SELECT * FROM t UNION ALL SELECT * FROM s WHERE o_orderkey NOT IN (SELECT o_orderkey FROM t)",
    "m_scd2_apply": """WITH c AS (SELECT c_custkey, c_mktsegment, DATE '2024-01-01' AS updated_at FROM customer), t AS (SELECT * FROM c WHERE c_custkey % 10 <> 9),
      s AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN DATE '2024-02-01' ELSE updated_at END AS updated_at FROM c WHERE c_custkey % 7 <> 0)
      SELECT t.c_custkey, t.c_mktsegment, t.updated_at, md5(t.c_custkey || '-' || t.updated_at) AS scd_id, t.updated_at AS valid_from,
        CASE WHEN s.c_custkey IS NULL THEN DATE '2024-03-01' WHEN s.updated_at > t.updated_at THEN s.updated_at END AS valid_to FROM t LEFT JOIN s ON s.c_custkey = t.c_custkey
      UNION ALL SELECT s.c_custkey, s.c_mktsegment, s.updated_at, md5(s.c_custkey || '-' || s.updated_at), s.updated_at, NULL FROM s LEFT JOIN t ON s.c_custkey = t.c_custkey WHERE t.c_custkey IS NULL OR s.updated_at > t.updated_at""",
    "m_schema_sync": "SELECT n_nationkey, n_name, n_regionkey, CASE WHEN n_nationkey >= 10 THEN lower(n_name) END AS n_comment FROM nation",
    "a_city_service": f"""WITH r AS (SELECT o_orderkey, n_name, o_orderpriority, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS d FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)
      SELECT d AS metric_date, n_name AS city_code, o_orderpriority AS service_type, count(DISTINCT o_orderkey) AS requested_rides, count(*) FILTER (o_orderstatus = 'F') AS completed_rides,
      count(*) FILTER (o_orderstatus = 'P') AS cancelled_rides, {_sum("CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END")} AS gross_revenue,
      CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) / count(DISTINCT o_orderkey) AS completion_rate, CAST(count(*) FILTER (o_orderstatus = 'P') AS DOUBLE) / count(DISTINCT o_orderkey) AS cancellation_rate,
      {_sum("CASE WHEN o_orderstatus = 'F' THEN o_totalprice END")} / nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS avg_fare FROM r GROUP BY 1, 2, 3""",
    "a_payment_method": f"""SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS metric_month, coalesce(c_mktsegment, 'UNKNOWN') AS method_code, count(*) AS payment_attempts, count(*) FILTER (o_orderstatus = 'F') AS paid_payments,
      CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) / count(*) AS success_rate, {_sum('o_totalprice')} AS amount FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'MACHINERY') ON o_custkey = c_custkey GROUP BY 1, 2""",
    "a_refunds": f"SELECT CAST(l_shipdate AS DATE) AS metric_date, l_linestatus, count(*) AS refund_count, {_sum('l_extendedprice')} AS refund_amount, {_sum('l_extendedprice')} / count(*) AS avg_refund FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2",
    "a_driver_perf": f"""SELECT s_suppkey, l_returnflag, count(*) AS assigned, count(*) FILTER (l_linestatus = 'F') AS finished, CAST(count(*) FILTER (l_linestatus = 'F') AS DOUBLE) / count(*) AS rate, {_sum('coalesce(l_extendedprice, 0)')} AS earning,
      min(l_quantity) AS least_quantity, max(l_quantity) AS most_quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0 GROUP BY 1, 2""",
    "a_promo_perf": f"SELECT p_brand, p_type, count(*) AS promo_rides, {_sum('l_extendedprice')} AS revenue, {_sum('l_extendedprice')} / nullif({_sum('l_extendedprice * l_discount', 4)}, 0) AS revenue_per_discount FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "a_multi_distinct": "SELECT CAST(ts AS DATE) AS metric_date, count(DISTINCT user_id) AS users, " + ", ".join(f"count(DISTINCT CASE WHEN event_type = '{t}' THEN user_id END) AS {t}_users" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1",
    "a_weekly_distinct": "SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(DISTINCT user_id) AS users, " + ", ".join(f"count(DISTINCT CASE WHEN event_type = '{t}' THEN user_id END) AS {t}_users" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1",
    "m_schema_evolve": "SELECT o_orderkey, o_custkey AS customer, o_orderstatus AS status, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS price, CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS note FROM orders",
    "i_full_refresh": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 4 <> 0",
    "i_create_absent": "SELECT o_orderstatus, count(*) AS n, 0 AS before FROM orders GROUP BY 1",
    "st_strict": "SELECT event_id, user_id, event_type FROM events",
    "m_soft_delete": """SELECT c_custkey, c_name, CASE WHEN c_custkey NOT IN (SELECT o_custkey FROM orders) THEN TIMESTAMP '2024-02-01' WHEN c_custkey % 10 = 0 THEN TIMESTAMP '2024-03-01' END AS deleted_at FROM customer""",
    "q_gated_build": """SELECT o_orderstatus, count(*) AS n, (SELECT count(*) FROM orders WHERE o_orderkey % 10 = 0) AS not_null_status,
      (SELECT count(*) FROM orders WHERE o_orderkey % 10 IN (1, 2)) AS accepted_status, 0 AS price_between FROM orders GROUP BY 1""",
    "m_kept_snapshots": """WITH c AS (SELECT c_custkey AS k, c_mktsegment AS m FROM customer),
      s AS (SELECT r, k, CASE WHEN k % (4 + r) = 1 THEN m || r ELSE m END AS m, CASE WHEN k % (4 + r) = 1 THEN CAST(DATE '2024-01-01' + to_months(CAST(r AS INTEGER)) AS DATE)
        WHEN r = 2 AND k % 5 = 1 THEN DATE '2024-02-01' ELSE DATE '2024-01-01' END AS u FROM c, (SELECT unnest(range(3)) AS r) WHERE k % (9 + r) <> 1),
      f AS (SELECT a.k, a.m, a.u, CASE WHEN b.k IS NULL THEN DATE '2024-02-20' WHEN b.u > a.u THEN b.u END AS t FROM s a LEFT JOIN s b ON b.k = a.k AND b.r = 1 WHERE a.r = 0),
      n AS (SELECT b.k, b.m, b.u FROM s b LEFT JOIN s a ON a.k = b.k AND a.r = 0 WHERE b.r = 1 AND (a.k IS NULL OR b.u > a.u)),
      o AS (SELECT k, m, u FROM f WHERE t IS NULL UNION ALL SELECT * FROM n),
      g AS (SELECT o.k, o.m, o.u, CASE WHEN d.k IS NULL THEN DATE '2024-03-20' WHEN d.u > o.u THEN d.u END AS t FROM o LEFT JOIN s d ON d.k = o.k AND d.r = 2),
      h AS (SELECT * FROM f WHERE t IS NOT NULL UNION ALL SELECT * FROM g UNION ALL SELECT d.k, d.m, d.u, NULL FROM s d LEFT JOIN o ON o.k = d.k WHERE d.r = 2 AND (o.k IS NULL OR d.u > o.u))
      SELECT k AS c_custkey, m AS c_mktsegment, u AS updated_at, md5(k || '-' || u) AS scd_id, u AS valid_from, t AS valid_to FROM h""",
    "a_global": "SELECT count(*) AS rows, coalesce(max(o_orderkey), 0) AS top_key, min(CAST(o_orderdate AS DATE)) AS first_day, max(CAST(o_orderdate AS DATE)) AS last_day FROM orders",
    "w_funnel": """WITH b AS (SELECT CAST(ts AS DATE) AS metric_date, event_type, count(*) AS n FROM events GROUP BY 1, 2), d AS (SELECT DISTINCT metric_date FROM b),
      s AS (SELECT * FROM (VALUES (CAST(1 AS BIGINT), '01 view', 'view'), (2, '02 click', 'click'), (3, '03 signup', 'signup'), (4, '04 purchase', 'purchase')) v(step_number, funnel_step, t)),
      l AS (SELECT d.metric_date, step_number, funnel_step, coalesce(n, 0) AS ride_count FROM d CROSS JOIN s LEFT JOIN b ON b.metric_date = d.metric_date AND b.event_type = s.t),
      w AS (SELECT *, first_value(ride_count) OVER (PARTITION BY metric_date ORDER BY step_number) AS starting_ride_count, lag(ride_count) OVER (PARTITION BY metric_date ORDER BY step_number) AS previous_step_ride_count FROM l)
      SELECT md5(metric_date || '-' || step_number) AS ride_funnel_step_daily_sk, *, CAST(ride_count AS DOUBLE) / nullif(starting_ride_count, 0) AS conversion_from_start_rate,
      CAST(ride_count AS DOUBLE) / nullif(previous_step_ride_count, 0) AS conversion_from_previous_step_rate, 1 - CAST(ride_count AS DOUBLE) / nullif(previous_step_ride_count, 0) AS dropoff_from_previous_step_rate FROM w""",
    "w_pct_of_total": "SELECT o_orderpriority, count(*) AS n, CAST(round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS DOUBLE) AS pct FROM orders GROUP BY 1",
    "t_top1_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1",
    "i_lookback_max": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) >= (SELECT coalesce(max(CAST(o_orderdate AS DATE)), DATE '2024-01-01') FROM orders WHERE o_orderkey % 2 = 0) - 3",
    "i_lookback_clock": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '2001-07-20' - 7",
    "i_insert_overwrite": "SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '2001-01-01' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders",
    "s_dim_date": """SELECT CAST(d AS DATE) AS date_day, year(d) AS year_number, quarter(d) AS quarter_of_year, month(d) AS month_of_year, weekofyear(d) AS iso_week_of_year, dayofweek(d) + 1 AS day_of_week, day(d) AS day_of_month, dayofyear(d) AS day_of_year,
      CAST(date_trunc('month', d) AS DATE) AS month_start_date, CAST(last_day(d) AS DATE) AS month_end_date, CAST(date_trunc('quarter', d) AS DATE) AS quarter_start_date, CAST(date_trunc('year', d) AS DATE) AS year_start_date
      FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2050-12-30', INTERVAL 1 DAY) g(d)""",
    "q_failures": """SELECT 'not_null_value' AS check_name, count(*) AS failures FROM events WHERE value IS NULL
      UNION ALL SELECT 'unique_orders', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
      UNION ALL SELECT 'unique_custkey', count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)
      UNION ALL SELECT 'accepted_status', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
      UNION ALL SELECT 'relationships_orders', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
      UNION ALL SELECT 'relationships_labels', count(*) FROM labels WHERE toxic = 1 AND doc_id NOT IN (SELECT doc_id FROM documents)
      UNION ALL SELECT 'between_quantity', count(*) FROM lineitem WHERE NOT (l_quantity BETWEEN 2 AND 49)
      UNION ALL SELECT 'strictly_discount', count(*) FROM lineitem WHERE NOT (l_discount > 0 AND l_discount < 0.1)
      UNION ALL SELECT 'unique_combo_lines', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
      UNION ALL SELECT 'unique_nation', count(*) FROM (SELECT n_name FROM nation GROUP BY 1 HAVING count(*) > 1)""",
    "v_date_coverage": "SELECT min(d) AS first_day, max(d) AS last_day, count(*) AS days, max(d) - min(d) + 1 - count(*) AS missing_days FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)",
    "v_hour_demand": f"SELECT hour({_LOCAL}) AS hour, {_PEAK} AS is_peak, count(*) AS rides FROM events GROUP BY 1, 2",
    "v_promo_usage": f"SELECT p_brand, count(*) AS usages, count(DISTINCT l_orderkey) AS rides, {_sum('l_extendedprice')} AS amount FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY 2 DESC, 1",
}
_SQL["g_fares"] = """WITH i AS (SELECT o_orderkey, (o_orderkey % 300 + 5) / 10.0 AS km, o_orderkey % 70 + 6 AS minutes, (o_orderkey % 4) * 0.2 AS more FROM orders),
r AS (SELECT *, 8000 + km * 2500 + minutes * 300 AS ride FROM i), x AS (SELECT *, round(ride * more, 2) AS extra FROM r), g AS (SELECT *, ride + extra AS gross FROM x),
f AS (SELECT *, round(gross * 0.11, 2) AS tax, round(gross * 0.18, 2) AS fee FROM g)
SELECT o_orderkey, CAST(8000 AS DOUBLE) AS base_fare, CAST(round(km * 2500, 2) AS DOUBLE) AS distance_fare, CAST(minutes * 300 AS DOUBLE) AS time_fare, CAST(extra AS DOUBLE) AS surge_amount, CAST(0 AS DOUBLE) AS discount_amount,
CAST(tax AS DOUBLE) AS tax_amount, CAST(fee AS DOUBLE) AS platform_fee, CAST(round(gross - fee, 2) AS DOUBLE) AS driver_earning, CAST(round(gross + tax, 2) AS DOUBLE) AS total_fare FROM f"""
for _name in ("st_cdc_current", "st_upsert_sink", "st_bootstrap", "st_state_current"):
    _SQL[_name] = _SQL["d_cdc_current"]
_SQL["d_cdc_current"] = _SQL["d_cdc_current"].replace("value, __op FROM (", "value, __op, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS _bq_partition_time, strftime(ts + INTERVAL 7 HOURS, '%Y-%m-%d %H:00:00') AS _load_hour_jakarta FROM (", 1)
_SQL["i_merge_store"] = _SQL["m_upsert_always"]
def _source_sql(name: str) -> str:
    """A stand-in table with those that it reads."""
    needed = [x for x in VIEWS if x in ("asked", "ride", "priced", name)]
    return "WITH " + ", ".join(f"src_{x} AS ({as_sql(x)})" for x in needed) + f" SELECT * FROM src_{name}"


_JSON = "'{\"event_id\":' || event_id || ',\"user_id\":' || user_id || ',\"event_type\":\"' || event_type || '\"}'"
_NY = "CAST(CAST(ts AS TIMESTAMP) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS TIMESTAMP)"
_SQL |= {
    "st_clock_folders": "SELECT 2024 AS year, 3 AS month, 1 AS day, 1 AS hour, count(*) AS events, min(event_id) AS first_event, max(event_id) AS last_event FROM events",
    "st_dead_letters": f"""SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE event_id % 10 NOT IN (3, 4) GROUP BY 1
      UNION ALL SELECT 'not a record of the schema', count(*), CAST(sum(length(substring({_JSON}, 1, 12))) AS BIGINT) FROM events WHERE event_id % 10 = 3 UNION ALL SELECT 'no value', count(*), 0 FROM events WHERE event_id % 10 = 4""",
    "st_envelope": f"SELECT event_id, user_id, event_type, __op, 'events' AS __table, __lsn, __source_ts_ms FROM {_EVENTS} WHERE __op <> 'd' OR event_id % 4 <> 0",
    "i_hour_load": "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE ts >= TIMESTAMP '2024-01-03 05:00:00' AND ts < TIMESTAMP '2024-01-03 08:00:00' GROUP BY 1",
    "i_write_query": "SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice * 2 END AS doubled FROM orders",
    "i_clustered_ranges": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice FROM lineitem, (SELECT max(l_partkey) AS most FROM lineitem)
      WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-04-01' AND l_partkey BETWEEN most // 2 AND most // 2 + most // 20""",
    "i_catch_up": """WITH e AS (SELECT CAST(ts AS DATE) AS day, event_id, CAST(ts AS DATE) - (SELECT min(CAST(ts AS DATE)) FROM events) AS k FROM events),
      d AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM e), (SELECT max(day) FROM e), INTERVAL 1 DAY)) AS DATE) AS day), n AS (SELECT day, day - (SELECT min(day) FROM d) AS k FROM d),
      l AS (SELECT day, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS ids FROM e WHERE k NOT IN (1, 2, 4, 9) GROUP BY 1)
      SELECT n.day, CASE WHEN k = 4 THEN 'skipped' ELSE 'loaded' END AS status, CASE k WHEN 4 THEN 0 WHEN 6 THEN 2 ELSE 1 END AS tries, events, ids, 3 AS gaps, 0 AS again FROM n LEFT JOIN l ON n.day = l.day""",
    "i_truncate_reset": "SELECT max(o_orderkey) + 1 AS next_before, 1 AS next_after, 0 AS rows_left FROM orders",
    "s_statement_list": "SELECT c_mktsegment, count(*) AS n, min(o_totalprice) AS least FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000 GROUP BY 1",
    "j_two_systems": "SELECT o_orderkey, o_custkey, c_name, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'",
    "c_change_files": f"SELECT event_id, user_id, __op, CASE WHEN event_id % 2 = 1 THEN event_id * 2 END AS extra, 5 + event_id % 2 AS hour FROM {_EVENTS}",
    "i_ingest_merge": f"""WITH p AS ({_source_sql('payment_transaction')}),
      f AS (SELECT payment_transaction_id, ride_id, payment_status, CAST(method_fee AS DOUBLE) AS method_fee, updated_at, updated_at >= TIMESTAMP '1996-01-01' AND updated_at < TIMESTAMP '1998-01-01' AS inside FROM p),
      l AS (SELECT payment_transaction_id, updated_at + INTERVAL '1' DAY * (ride_id % 3 - 1) AS updated_at FROM f)
      SELECT f.payment_transaction_id, ride_id, payment_status, CASE WHEN inside AND f.updated_at >= l.updated_at THEN method_fee ELSE 7 END AS method_fee, CASE WHEN inside AND f.updated_at >= l.updated_at THEN f.updated_at ELSE l.updated_at END - INTERVAL 7 HOURS AS updated_at,
      TIMESTAMP '2024-01-01' AS _ingested_at, 'billing_growth_db' AS _source_system FROM f JOIN l ON f.payment_transaction_id = l.payment_transaction_id""",
    "i_ingest_append": "SELECT event_type AS new_status, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id, 3 AS loads, 'ride-status-history' AS label FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-15' GROUP BY 1",
    "p_ingested": """SELECT user_id, CAST(event_id AS VARCHAR) AS event_id, event_type, ts - INTERVAL 7 HOURS AS ts, TIMESTAMP '2024-01-20' AS _ingested_at, 'o''brien' AS _source_system
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15') WHERE rn = 1""",
    "p_zone_window": """SELECT click_id, arrived_at, client_id, kind, ts + CASE WHEN ts < TIMESTAMP '2024-03-10 03:00:00' THEN INTERVAL 5 HOURS ELSE INTERVAL 4 HOURS END AS ts, '2024031300' AS upto
      FROM clicks WHERE ts >= TIMESTAMP '2024-03-07 19:00:00' AND ts < TIMESTAMP '2024-03-12 20:00:00'""",
    "p_time_formats": f"""SELECT event_id, strftime({_LOCAL}, '%Y-%m-%d %H:00:00') AS jakarta_hour, strftime(ts - INTERVAL 5 HOURS, '%Y-%m-%d %H:%M') AS new_york, ts + INTERVAL 5 HOURS AS from_new_york, CAST({_LOCAL} AS DATE) AS jakarta_day,
      {', '.join(f"CAST(date_trunc('{u}', ts) AS TIMESTAMP) AS {u}_start" for u in ('hour', 'day', 'month', 'year'))} FROM events""",
    "p_to_json": """SELECT o_orderkey, '{"customer":' || o_custkey || ',"status":"' || o_orderstatus || '"}' AS payload FROM orders""",
    "p_clamp": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(CAST(100 AS DOUBLE), least(l_extendedprice * l_discount, least(CAST(2500 AS DOUBLE), l_extendedprice))) AS discount FROM lineitem",
    "d_latest_version": "SELECT l_orderkey, l_linenumber, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_shipdate DESC) AS rn FROM lineitem) WHERE rn = 1",
    "d_cdc_arrival": f"""SELECT user_id, event_id, event_type, __op, 1 AS arrived FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY __source_ts_ms DESC, __lsn DESC) AS rn FROM {_EVENTS}) WHERE rn = 1 AND __op <> 'd' AND event_id % 3 <> 0""",
    "a_averages": "SELECT l_returnflag, avg(l_linenumber) AS mean_line, avg(CASE WHEN l_linestatus = 'F' THEN l_linenumber END) AS mean_finished, avg(CASE WHEN l_linenumber > 99 THEN 1 END) AS mean_of_none FROM lineitem GROUP BY 1",
    "t_seeded_sample": "SELECT s_suppkey, s_name FROM supplier ORDER BY md5('42:' || s_suppkey), s_suppkey LIMIT 10",
    "g_demand": f"""SELECT CAST(d AS DATE) AS day, h AS hour, ({demand_expr('d', '(isodow(d) - 1)')}) * ({hour_expr('d', 'h', '(isodow(d) - 1)')}) / {sum(HOURS)!r}e0 AS share
      FROM (SELECT unnest(generate_series(DATE '2026-01-01', DATE '2026-06-30', INTERVAL 1 DAY)) AS d) CROSS JOIN (SELECT unnest(range(24)) AS h)""",
    "g_mix": f"""WITH e AS (SELECT event_id, CAST(ts AS DATE) AS d, hour(ts) AS h, isodow(ts) - 1 AS w, (['JKT', 'BDG', 'SBY'])[event_id % 3 + 1] AS city FROM events),
      m AS (SELECT *, {', '.join(f'{x} AS share_{k.lower()}' for k, x in (city_weights('d', 'h', 'w') | service_weights('d', 'h', 'city', 'w')).items())},
      {', '.join(f'{x} AS {k}' for k, x in context_flags('d', 'h', 'city', '(event_id % 100) / 100e0', '(event_id % 37) / 37e0', 'w').items())} FROM e)
      SELECT * EXCLUDE (d, h, w), {', '.join(f'{x} AS weight_{k.lower()}' for k, x in outcome_weights('event_id % 10 > 6', 'event_id % 20 > 16', 'event_id % 4 = 0').items())} FROM m""",
}
_SQL["st_hour_buckets"] = f"SELECT strftime({_LOCAL}, '%Y-%m-%d %H') AS load_hour, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY 1"


def sql() -> dict[str, str]:
    return dict(_SQL)

"""The models as DuckDB SQL over the driver's tables: one common table expression a model, each with those that it reads."""

from __future__ import annotations

import re

from ridgeline.functions.schema import TABLES
from ridgeline.plans.stand_in import BUILT, SECOND, VIEWS, as_sql

_TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "decimal(38,9)": "DECIMAL(38,9)", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
#: Fixed value: what stands for a null part of a surrogate key.
_NULL = "_dbt_utils_surrogate_key_null_"
_CASED = (
    "account_status city_code driver_status verification_status license_plate vehicle_type vehicle_status ride_status service_type cancelled_by_type cancel_reason_code fare_type currency_code fare_rule_code shift_status old_status new_status "
    "changed_by_type reason_code location_type method_code payment_method_status payment_status failure_code refund_reason_code refund_status promo_code discount_type promotion_status reviewer_type reviewee_type review_status ticket_category ticket_status priority"
).split()
_LOADED = f"TIMESTAMP '{BUILT}' AS _dbt_loaded_at"


def _sk(*parts: str) -> str:
    return "md5(concat_ws('-', " + ", ".join(f"coalesce(CAST({p} AS VARCHAR), '{_NULL}')" for p in parts) + "))"


def _div(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0)"


def _minutes(a: str, b: str) -> str:
    return f"date_sub('minute', {a}, {b})"


def _local(ts: str) -> str:
    return f"({ts} + INTERVAL 7 HOURS)"


def _staged(table: str, renamed: dict[str, str] | None = None) -> str:
    out = []
    for f in TABLES[table].schema:
        x = f"CAST({f.name} AS {_TYPES[f.dataType.simpleString()]})"
        x = f"upper({x})" if f.name in _CASED else f"lower({x})" if f.name == "provider_name" else x
        out.append(f"{x} AS {(renamed or {}).get(f.name, f.name)}")
    if "deleted_at" in TABLES[table].schema.names:
        out.append("deleted_at IS NOT NULL AS is_deleted")
    return ", ".join(out)


def _latest(table: str, order: str, where: str = "true") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ride_id ORDER BY {order}) AS rn FROM {table} WHERE {where}) WHERE rn = 1)"


def _as_of(dim: str, key: str, at: str, of: str = "b") -> str:
    return f"LEFT JOIN dim_{dim} d_{dim} ON {of}.{key} = d_{dim}.{key} AND {at} >= d_{dim}.valid_from AND {at} < coalesce(d_{dim}.valid_to, TIMESTAMP '9999-12-31')"


_SNAPSHOTS = {"rider_account": ("rider_id", "rider"), "driver_profile": ("driver_id", "driver"), "vehicle": ("vehicle_id", "vehicle"), "driver_vehicle_assignment": ("assignment_id", "assignment"), "payment_method": ("payment_method_id", "payment_method"), "promotion": ("promotion_id", "promotion")}
_RENAMED = {"promotion": {"valid_from": "promo_valid_from", "valid_to": "promo_valid_to"}}

MODELS: dict[str, str] = {f"src_{name}": as_sql(name) for name in VIEWS}
for _t, (_k, _p) in _SNAPSHOTS.items():
    MODELS[f"snap_{_t}"] = f"""SELECT f.*, f.updated_at AS scd_from, CASE WHEN s.{_k} IS NULL THEN TIMESTAMP '{SECOND}' WHEN s.updated_at > f.updated_at THEN s.updated_at END AS scd_to FROM src_{_t}_1 f LEFT JOIN src_{_t}_2 s ON f.{_k} = s.{_k}
      UNION ALL SELECT s.*, s.updated_at, NULL FROM src_{_t}_2 s LEFT JOIN src_{_t}_1 f ON f.{_k} = s.{_k} WHERE f.{_k} IS NULL OR s.updated_at > f.updated_at"""
    MODELS[f"stg_{_t}"] = f"SELECT md5(concat_ws('|', CAST({_k} AS VARCHAR), CAST(updated_at AS VARCHAR))) AS {_p}_snapshot_id, {_staged(_t, _RENAMED.get(_t))}, scd_from AS valid_from, scd_to AS valid_to, scd_to IS NULL AS is_current FROM snap_{_t}"
    _soft = " EXCLUDE (deleted_at)" if "deleted_at" in TABLES[_t].schema.names else ""
    _made = "" if _p == "assignment" else f", CAST(created_at AS DATE) AS {_p}_created_date"
    MODELS["dim_driver_vehicle_assignment" if _p == "assignment" else f"dim_{_p}"] = f"SELECT {_sk(_k, 'valid_from')} AS {_p}_sk, *{_soft}{_made} FROM stg_{_t}"
for _t in TABLES:
    if _t not in _SNAPSHOTS:
        MODELS[f"stg_{_t}"] = f"SELECT {_staged(_t)} FROM src_{_t}"
_AT = _local("requested_at")
MODELS["stg_ride"] = f"""SELECT {_staged('ride')}, CAST({_AT} AS DATE) AS requested_date, hour({_AT}) AS requested_hour, dayofweek({_AT}) IN (0, 6) AS is_weekend, (hour({_AT}) BETWEEN 7 AND 9 OR hour({_AT}) BETWEEN 17 AND 20) AS is_peak_hour,
  src_ride.ride_status = 'COMPLETED' AS is_completed, src_ride.ride_status = 'CANCELLED' AS is_cancelled, src_ride.ride_status = 'PAYMENT_FAILED' AS is_payment_failed FROM src_ride"""
MODELS["int_ride_lifecycle"] = f"""SELECT *, {_minutes('requested_at', 'accepted_at')} AS accept_delay_min, {_minutes('accepted_at', 'arrived_at')} AS driver_arrival_min, {_minutes('arrived_at', 'started_at')} AS pickup_wait_min, {_minutes('started_at', 'completed_at')} AS actual_ride_duration_min,
  CASE WHEN is_completed THEN 'completed' WHEN is_cancelled THEN 'cancelled' WHEN is_payment_failed THEN 'payment_failed' ELSE 'incomplete' END AS lifecycle_outcome FROM stg_ride WHERE NOT is_deleted"""
MODELS["int_ride_financials"] = f"""SELECT r.* EXCLUDE (created_at, updated_at, deleted_at, is_deleted), f.fare_id, f.distance_km, f.duration_min, f.base_fare, f.distance_fare, f.time_fare, f.surge_multiplier, f.surge_amount, f.discount_amount, f.tax_amount, f.platform_fee, f.driver_earning, f.total_fare,
  p.payment_transaction_id, p.payment_method_id, p.payment_status, p.failure_code, p.amount AS payment_amount, p.method_fee AS payment_method_fee, p.paid_at, u.promotion_id, u.discount_amount_applied AS promo_discount_amount, u.used_at AS promo_used_at
  FROM int_ride_lifecycle r LEFT JOIN {_latest('stg_ride_fare', 'fare_version DESC, updated_at DESC, fare_id DESC')} f ON r.ride_id = f.ride_id
  LEFT JOIN {_latest('stg_payment_transaction', 'updated_at DESC, payment_transaction_id DESC', 'NOT is_deleted')} p ON r.ride_id = p.ride_id LEFT JOIN stg_promo_usage u ON r.ride_id = u.ride_id"""
MODELS["int_customer_feedback"] = f"""SELECT coalesce(v.ride_id, t.ride_id) AS ride_id, v.review_id, v.rating_score, v.comments, v.created_at AS reviewed_at, t.ticket_id, t.ticket_category, t.ticket_status, t.priority, t.opened_at, t.resolved_at, {_minutes('t.opened_at', 't.resolved_at')} AS ticket_resolution_min
  FROM {_latest('stg_review', 'updated_at DESC, review_id DESC', "NOT is_deleted AND review_status = 'PUBLISHED'")} v FULL JOIN {_latest('stg_support_ticket', 'updated_at DESC, ticket_id DESC', 'NOT is_deleted')} t ON v.ride_id = t.ride_id"""
MODELS["dim_date"] = """SELECT CAST(d AS DATE) AS date_day, year(d) AS year_number, quarter(d) AS quarter_of_year, month(d) AS month_of_year, weekofyear(d) AS iso_week_of_year, dayofweek(d) + 1 AS day_of_week, day(d) AS day_of_month, dayofyear(d) AS day_of_year,
  CAST(date_trunc('month', d) AS DATE) AS month_start_date, last_day(d) AS month_end_date, CAST(date_trunc('quarter', d) AS DATE) AS quarter_start_date, CAST(date_trunc('year', d) AS DATE) AS year_start_date FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2050-12-30', INTERVAL 1 DAY)) AS d)"""
_RIDE = (
    "rider_id driver_id vehicle_id payment_method_id promotion_id payment_transaction_id fare_id city_code service_type ride_status lifecycle_outcome requested_date requested_at accepted_at arrived_at started_at completed_at cancelled_at cancelled_by_type cancel_reason_code is_completed is_cancelled is_payment_failed is_weekend "
    "is_peak_hour requested_hour estimated_distance_km estimated_duration_min distance_km duration_min accept_delay_min driver_arrival_min pickup_wait_min actual_ride_duration_min base_fare distance_fare time_fare surge_multiplier surge_amount discount_amount tax_amount platform_fee driver_earning total_fare payment_status failure_code "
    "payment_amount payment_method_fee promo_discount_amount"
).split()
_TAKEN, _PAID, _USED = "coalesce(b.accepted_at, b.requested_at)", "coalesce(b.paid_at, b.completed_at, b.requested_at)", "coalesce(b.promo_used_at, b.completed_at, b.requested_at)"
MODELS["fct_rides"] = f"""SELECT {_sk('b.ride_id')} AS ride_sk, b.ride_id, rider_sk, driver_sk, vehicle_sk, payment_method_sk, promotion_sk, {', '.join(f'b.{c}' for c in _RIDE)}, c.review_id, c.rating_score, c.ticket_id, c.ticket_category, c.ticket_status, c.priority, {_LOADED}
  FROM int_ride_financials b {_as_of('rider', 'rider_id', 'b.requested_at')} {_as_of('driver', 'driver_id', _TAKEN)} {_as_of('vehicle', 'vehicle_id', _TAKEN)} {_as_of('payment_method', 'payment_method_id', _PAID)} {_as_of('promotion', 'promotion_id', _USED)} LEFT JOIN int_customer_feedback c ON b.ride_id = c.ride_id"""
MODELS["fct_payments"] = f"""SELECT {_sk('b.payment_transaction_id')} AS payment_transaction_sk, r.ride_sk, d_rider.rider_sk, d_payment_method.payment_method_sk, b.* EXCLUDE (deleted_at, is_deleted), CAST({_local('b.created_at')} AS DATE) AS payment_date, {_LOADED} FROM stg_payment_transaction b
  {_as_of('rider', 'rider_id', 'b.created_at')} {_as_of('payment_method', 'payment_method_id', 'b.created_at')} LEFT JOIN fct_rides r ON b.ride_id = r.ride_id WHERE NOT b.is_deleted"""
MODELS["fct_refunds"] = f"""SELECT {_sk('b.refund_id')} AS refund_sk, b.*, CAST({_local('b.requested_at')} AS DATE) AS refund_date, p.payment_transaction_sk, r.ride_sk, {_minutes('b.requested_at', 'b.processed_at')} AS refund_processing_min, {_LOADED}
  FROM stg_payment_refund b LEFT JOIN fct_payments p ON b.payment_transaction_id = p.payment_transaction_id LEFT JOIN fct_rides r ON b.ride_id = r.ride_id"""
MODELS["fct_support_tickets"] = f"""SELECT {_sk('b.ticket_id')} AS ticket_sk, b.* EXCLUDE (deleted_at, is_deleted), CAST({_local('b.opened_at')} AS DATE) AS opened_date, d_rider.rider_sk, d_driver.driver_sk, r.ride_sk, {_minutes('b.opened_at', 'b.resolved_at')} AS resolution_min, {_LOADED} FROM stg_support_ticket b
  {_as_of('rider', 'rider_id', 'b.opened_at')} {_as_of('driver', 'driver_id', 'b.opened_at')} LEFT JOIN fct_rides r ON b.ride_id = r.ride_id WHERE NOT b.is_deleted"""
MODELS["agg_daily_city_service"] = f"""SELECT requested_date AS metric_date, city_code, service_type, count(DISTINCT ride_id) AS requested_rides, count(*) FILTER (WHERE is_completed) AS completed_rides, count(*) FILTER (WHERE is_cancelled) AS cancelled_rides, count(*) FILTER (WHERE is_payment_failed) AS payment_failed_rides,
  {_div('count(*) FILTER (WHERE is_completed)', 'count(DISTINCT ride_id)')} AS completion_rate, {_div('count(*) FILTER (WHERE is_cancelled)', 'count(DISTINCT ride_id)')} AS cancellation_rate, sum(coalesce(total_fare, 0)) AS gross_revenue, sum(coalesce(platform_fee, 0)) AS platform_revenue, sum(coalesce(driver_earning, 0)) AS driver_earnings,
  avg(accept_delay_min) AS avg_accept_delay_min, avg(driver_arrival_min) AS avg_driver_arrival_min, avg(rating_score) AS avg_rating, {_LOADED} FROM fct_rides GROUP BY ALL"""
MODELS["agg_daily_payment_method"] = f"""SELECT payment_date AS metric_date, coalesce(method_code, 'UNKNOWN') AS method_code, p.provider_name, count(*) AS payment_attempts, count(*) FILTER (WHERE payment_status = 'PAID') AS paid_payments, count(*) FILTER (WHERE payment_status = 'FAILED') AS failed_payments, {_div("count(*) FILTER (WHERE payment_status = 'PAID')", 'count(*)')} AS payment_success_rate,
  sum(amount) AS payment_amount, sum(method_fee) AS method_fee, {_LOADED} FROM fct_payments p LEFT JOIN dim_payment_method m ON p.payment_method_sk = m.payment_method_sk GROUP BY ALL"""
MODELS["agg_daily_refunds"] = f"SELECT refund_date AS metric_date, refund_status, refund_reason_code, count(*) AS refund_count, sum(refund_amount) AS refund_amount, avg(refund_processing_min) AS avg_refund_processing_min, {_LOADED} FROM fct_refunds GROUP BY ALL"
MODELS["agg_driver_performance_daily"] = f"""SELECT requested_date AS metric_date, driver_sk, city_code, service_type, count(*) AS assigned_rides, count(*) FILTER (WHERE is_completed) AS completed_rides, {_div('count(*) FILTER (WHERE is_completed)', 'count(*)')} AS driver_completion_rate, sum(coalesce(driver_earning, 0)) AS driver_earning,
  avg(driver_arrival_min) AS avg_arrival_min, avg(rating_score) AS avg_rating, count(*) FILTER (WHERE priority = 'HIGH') AS high_priority_tickets, {_LOADED} FROM fct_rides WHERE driver_sk IS NOT NULL GROUP BY ALL"""
MODELS["agg_promo_performance_daily"] = f"""SELECT requested_date AS metric_date, promotion_sk, city_code, service_type, count(*) AS promo_rides, count(*) FILTER (WHERE is_completed) AS completed_promo_rides, sum(coalesce(promo_discount_amount, 0)) AS promo_discount_amount, sum(coalesce(total_fare, 0)) AS gross_revenue_after_discount,
  {_div('sum(coalesce(total_fare, 0))', 'sum(coalesce(promo_discount_amount, 0))')} AS revenue_per_promo_discount, avg(rating_score) AS avg_rating, {_LOADED} FROM fct_rides WHERE promotion_sk IS NOT NULL GROUP BY ALL"""
_STEPS = (("01 Ride Requested", "true"), ("02 Driver Accepted", "accepted_at IS NOT NULL"), ("03 Driver Arrived", "arrived_at IS NOT NULL"), ("04 Ride Started", "started_at IS NOT NULL"), ("05 Ride Completed", "ride_status = 'COMPLETED'"), ("06 Payment Paid", "payment_status = 'PAID'"))
_UNION = " UNION ALL ".join(f"SELECT requested_date AS metric_date, city_code, service_type, CAST({k} AS BIGINT) AS step_number, '{label}' AS funnel_step, count(DISTINCT CASE WHEN {what} THEN ride_id END) AS ride_count FROM fct_rides GROUP BY ALL" for k, (label, what) in enumerate(_STEPS, 1))
MODELS["agg_ride_funnel_steps_daily"] = f"""SELECT {_sk('metric_date', 'city_code', 'service_type', 'step_number')} AS ride_funnel_step_daily_sk, *, {_div('ride_count', 'starting_ride_count')} AS conversion_from_start_rate, {_div('ride_count', 'previous_step_ride_count')} AS conversion_from_previous_step_rate,
  1 - {_div('ride_count', 'previous_step_ride_count')} AS dropoff_from_previous_step_rate, TIMESTAMP '{BUILT}' AS transformed_at FROM (SELECT *, first_value(ride_count) OVER w AS starting_ride_count, lag(ride_count) OVER w AS previous_step_ride_count FROM ({_UNION}) WINDOW w AS (PARTITION BY metric_date, city_code, service_type ORDER BY step_number))"""


_FARE = "distance_km duration_min base_fare distance_fare time_fare surge_multiplier surge_amount discount_amount tax_amount platform_fee driver_earning total_fare".split()
_RIDES = ["estimated_distance_km", "estimated_duration_min", *_FARE, "payment_amount", "payment_method_fee", "promo_discount_amount"]
#: Decimals of a model, which its query gives as doubles.
DECIMALS: dict[str, list[str]] = {
    **{f"stg_{t}": [f.name for f in config.schema if f.dataType.simpleString().startswith("decimal")] for t, config in TABLES.items()},
    "int_ride_lifecycle": ["estimated_distance_km", "estimated_duration_min"], "int_ride_financials": _RIDES, "fct_rides": _RIDES, "fct_payments": ["amount", "method_fee"], "fct_refunds": ["refund_amount"],
    "agg_daily_city_service": ["gross_revenue", "platform_revenue", "driver_earnings"], "agg_daily_payment_method": ["payment_amount", "method_fee"], "agg_daily_refunds": ["refund_amount"],
    "agg_driver_performance_daily": ["driver_earning"], "agg_promo_performance_daily": ["promo_discount_amount", "gross_revenue_after_discount"],
}
DECIMALS |= {"dim_driver": DECIMALS["stg_driver_profile"], "dim_promotion": DECIMALS["stg_promotion"]}


def model_sql(name: str) -> str:
    """A model with all it reads, its decimals as doubles."""
    needed: list[str] = []

    def add(x: str) -> None:
        if x not in needed:
            for y in MODELS:
                if y != x and re.search(rf"\b{y}\b", MODELS[x]):
                    add(y)
            needed.append(x)

    add(name)
    ctes = ",\n".join(f"{x} AS ({MODELS[x]})" for x in needed)
    doubles = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in DECIMALS.get(name, ()))
    return f"WITH {ctes}\nSELECT *{f' REPLACE ({doubles})' if doubles else ''} FROM {name}"

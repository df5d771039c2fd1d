"""The operational tables of the models, derived from the driver's tables.

Each table is one SELECT in SQL that Spark and DuckDB read alike, over `{names}` of the driver's tables and of those before
it. Entities have two states: the one at the first snapshot, and the one at the second, by which some rows changed and some
are gone. Nothing is drawn by chance, and every row of the driver's tables counts.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

from ridgeline.operators.store import Store

#: The driver's tables that the derivations read.
GIVEN = ("orders", "customer", "supplier", "part", "events")
#: When the second snapshot is taken, and when models are built.
SECOND, BUILT = "1996-06-01 00:00:00", "2024-01-01 00:00:00"
NAIVE, EMPTY_TIME = "TIMESTAMP_NTZ", "CAST(NULL AS TIMESTAMP_NTZ)"

#: What is done (completed or not paid), cancelled, or at least accepted, by the last part of an order's key.
_DONE, _CANCELLED, _TAKEN = "(k < 41 OR k = 46 OR k = 47)", "(k >= 41 AND k < 46)", "k <> 48"
_CITY = "CASE {key} % 3 WHEN 0 THEN 'jkt' WHEN 1 THEN 'BDG' ELSE 'sby' END"
_BORN = "TIMESTAMP_NTZ '1994-06-01 00:00:00' + INTERVAL '1' HOUR * ({key} % 1000)"


def _minutes(at: str, n: str) -> str:
    return f"{at} + INTERVAL '1' MINUTE * ({n})"


def _states(name: str, key: str, table: str, given: str, columns: str, changing: str) -> dict[str, str]:
    """Both states of an entity. `changing` holds `{old|new}` pairs; every tenth key changed, every thirteenth is gone by the second."""
    def state(second: bool) -> str:
        turned = f"({given} % 10 = 3)" if second else "(1 = 0)"
        pairs = changing
        while "{" in pairs:
            head, _, rest = pairs.partition("{")
            pair, _, tail = rest.partition("}")
            old, new = pair.split("|")
            pairs = f"{head}CASE WHEN {turned} THEN {new} ELSE {old} END{tail}"
        born = _BORN.format(key=given)
        later = f"CASE WHEN {turned} THEN {born} + INTERVAL '1' DAY * 400 ELSE {born} END"
        gone = f" WHERE {given} % 13 <> 5" if second else ""
        return f"SELECT {given} AS {key}, {columns}, {pairs}, {born} AS created_at, {later} AS updated_at, {EMPTY_TIME} AS deleted_at FROM {{{table}}}{gone}"

    return {f"{name}_1": state(False), f"{name}_2": state(True)}


ENTITIES = ("rider_account", "driver_profile", "vehicle", "driver_vehicle_assignment", "payment_method", "promotion")

#: Tables by name, each after those that it reads.
VIEWS: dict[str, str] = {
    **_states("rider_account", "rider_id", "customer", "c_custkey", f"c_name AS username, concat('Rider ', CAST(c_custkey AS STRING)) AS full_name, concat('r', CAST(c_custkey AS STRING), '@example.com') AS email, CAST(c_nationkey AS STRING) AS phone_number, {_CITY.format(key='c_nationkey')} AS city_code", "{'active'|'suspended'} AS account_status"),
    **_states("driver_profile", "driver_id", "supplier", "s_suppkey", f"s_name AS driver_name, CAST(s_nationkey AS STRING) AS phone_number, {_CITY.format(key='s_nationkey')} AS city_code, 'verified' AS verification_status, CAST(s_suppkey % 6 AS DECIMAL(38,9)) AS rating_avg, s_suppkey % 500 AS rating_count", "{'available'|'busy'} AS driver_status"),
    **_states("vehicle", "vehicle_id", "supplier", "s_suppkey", "s_suppkey AS driver_id, concat('b', CAST(s_suppkey AS STRING), 'xy') AS license_plate, CASE s_suppkey % 3 WHEN 0 THEN 'bike' WHEN 1 THEN 'car' ELSE 'xl' END AS vehicle_type, 'Honda' AS vehicle_make, s_name AS vehicle_model, 2015 + s_suppkey % 11 AS vehicle_year", "{'active'|'maintenance'} AS vehicle_status"),
    **_states("driver_vehicle_assignment", "assignment_id", "supplier", "s_suppkey", f"s_suppkey AS driver_id, s_suppkey AS vehicle_id, {_BORN.format(key='s_suppkey')} AS assigned_from, {EMPTY_TIME} AS assigned_to", "{1 = 1|1 = 0} AS is_active"),
    **_states("payment_method", "payment_method_id", "customer", "c_custkey", "c_custkey AS rider_id, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'card' WHEN 'MACHINERY' THEN 'bank_transfer' WHEN 'BUILDING' THEN 'cash' ELSE 'ewallet' END AS method_code, concat('Provider', CAST(c_custkey % 5 AS STRING)) AS provider_name, concat('****', CAST(c_custkey % 10000 AS STRING)) AS masked_account, 1 = 1 AS is_default", "{'active'|'expired'} AS payment_method_status"),
    **_states("promotion", "promotion_id", "part", "p_partkey", "concat('promo', CAST(p_partkey AS STRING)) AS promo_code, p_name AS promo_description, CASE WHEN p_partkey % 2 = 0 THEN 'percent' ELSE 'fixed' END AS discount_type, CASE WHEN p_partkey % 2 = 0 THEN CAST(10 + p_size AS DECIMAL(38,9)) END AS discount_pct, CASE WHEN p_partkey % 2 = 1 THEN CAST(2000 + 250 * p_size AS DECIMAL(38,9)) END AS discount_amount, "
              "CAST(15000 AS DECIMAL(38,9)) AS max_discount_amount, CAST(12000 AS DECIMAL(38,9)) AS min_fare_amount, TIMESTAMP_NTZ '1994-01-01 00:00:00' AS valid_from, TIMESTAMP_NTZ '2002-01-01 00:00:00' AS valid_to", "{'active'|'paused'} AS promotion_status"),
    "driver_shift": f"SELECT s_suppkey AS shift_id, s_suppkey AS driver_id, 'closed' AS shift_status, {_BORN.format(key='s_suppkey')} AS started_at, {_BORN.format(key='s_suppkey')} + INTERVAL '9' HOUR AS ended_at, {_BORN.format(key='s_suppkey')} AS created_at, {_BORN.format(key='s_suppkey')} + INTERVAL '9' HOUR AS updated_at FROM {{supplier}}",
    "asked": "SELECT o_orderkey AS ride_id, o_custkey AS rider_id, o_orderkey % (SELECT count(*) FROM {supplier}) AS driver_id, o_orderkey % (SELECT count(*) FROM {part}) AS promotion_id, o_orderkey % 50 AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS price, "
             f"CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'bike' WHEN '2' THEN 'Car' WHEN '3' THEN 'XL' ELSE 'BIKE' END AS service_type, {_CITY.format(key='c_nationkey')} AS city_code, {_minutes('o_orderdate', 'o_orderkey % 1440')} AS requested_at FROM {{orders}} LEFT JOIN {{customer}} ON o_custkey = c_custkey",
    # one status in fifty is not in capitals: staging compares it as it came
    "ride": f"""SELECT *, CASE WHEN k < 40 THEN 'COMPLETED' WHEN k = 40 THEN 'Completed' WHEN {_CANCELLED} THEN 'CANCELLED' WHEN {_DONE} THEN 'PAYMENT_FAILED' WHEN {_TAKEN} THEN 'in_progress' ELSE 'REQUESTED' END AS ride_status,
      CASE WHEN {_TAKEN} THEN driver_id END AS vehicle_id, CASE WHEN {_CANCELLED} THEN CASE WHEN ride_id % 3 = 0 THEN 'driver' ELSE 'rider' END END AS cancelled_by_type, CASE WHEN {_CANCELLED} THEN 'changed_mind' END AS cancel_reason_code,
      CASE WHEN {_TAKEN} THEN {_minutes('requested_at', '1 + ride_id % 6')} END AS accepted_at, CASE WHEN {_TAKEN} AND NOT {_CANCELLED} THEN {_minutes('requested_at', '4 + ride_id % 17')} END AS arrived_at,
      CASE WHEN {_TAKEN} AND NOT {_CANCELLED} THEN {_minutes('requested_at', '6 + ride_id % 19')} END AS started_at, CASE WHEN {_DONE} THEN {_minutes('requested_at', '30 + ride_id % 61')} END AS completed_at,
      CASE WHEN {_CANCELLED} THEN {_minutes('requested_at', '9')} END AS cancelled_at, CAST(ride_id % 190 + 10 AS DECIMAL(38,9)) AS estimated_distance_km, CAST(5 + ride_id % 55 AS DECIMAL(38,9)) AS estimated_duration_min,
      requested_at AS created_at, {_minutes('requested_at', '95')} AS updated_at, {EMPTY_TIME} AS deleted_at FROM {{asked}}""",
    "ride_status_history": "SELECT event_id AS ride_status_history_id, user_id AS ride_id, CASE WHEN event_id % 2 = 0 THEN 'requested' END AS old_status, event_type AS new_status, 'system' AS changed_by_type, user_id AS changed_by_id, CAST(NULL AS STRING) AS reason_code, CAST(NULL AS STRING) AS reason_note, ts AS changed_at, ts AS created_at FROM {events}",
    "ride_location": "SELECT 2 * ride_id AS ride_location_id, ride_id, 'pickup_requested' AS location_type, CAST(ride_id % 90 AS DECIMAL(38,9)) AS latitude, CAST(ride_id % 180 AS DECIMAL(38,9)) AS longitude, city_code AS address_text, requested_at AS captured_at, requested_at AS created_at FROM {ride} "
                     "UNION ALL SELECT 2 * ride_id + 1, ride_id, 'dropoff_actual', CAST(ride_id % 89 AS DECIMAL(38,9)), CAST(ride_id % 179 AS DECIMAL(38,9)), CAST(NULL AS STRING), completed_at, completed_at FROM {ride} WHERE completed_at IS NOT NULL",
    "ride_tracking_point": "SELECT ride_id AS tracking_point_id, ride_id, driver_id, CAST(ride_id % 90 AS DECIMAL(38,9)) AS latitude, CAST(ride_id % 180 AS DECIMAL(38,9)) AS longitude, CAST(15 + ride_id % 40 AS DECIMAL(38,9)) AS speed_kmh, started_at AS recorded_at, started_at AS created_at FROM {ride} WHERE started_at IS NOT NULL",
    "priced": f"SELECT *, CASE WHEN k < 41 OR ride_id % 5 = 0 THEN 1 ELSE 0 END AS paid, CASE WHEN ride_id % 4 = 1 THEN CAST(ride_id % 300 AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS off FROM {{ride}} WHERE {_DONE}",
    # a ride has up to two versions of its fare; the second corrects the first
    "ride_fare": "SELECT 2 * ride_id + n AS fare_id, ride_id, 'final' AS fare_type, 1 + n AS fare_version, 'idr' AS currency_code, estimated_distance_km AS distance_km, estimated_duration_min AS duration_min, CAST(8000 AS DECIMAL(38,9)) AS base_fare, CAST(price AS DECIMAL(38,9)) AS distance_fare, CAST(300 * (ride_id % 55) AS DECIMAL(38,9)) AS time_fare, "
                 "CAST(1 + ride_id % 2 AS DECIMAL(38,9)) AS surge_multiplier, CAST(ride_id % 700 AS DECIMAL(38,9)) AS surge_amount, CAST(off AS DECIMAL(38,9)) AS discount_amount, CAST(price * 0.11 AS DECIMAL(38,9)) AS tax_amount, CAST(price * 0.18 AS DECIMAL(38,9)) AS platform_fee, CAST(price * 0.82 AS DECIMAL(38,9)) AS driver_earning, CAST(price + n AS DECIMAL(38,9)) AS total_fare, "
                 f"'standard' AS fare_rule_code, n = 1 AS is_corrected, completed_at AS calculated_at, completed_at AS created_at, {_minutes('completed_at', 'n')} AS updated_at FROM (SELECT *, 0 AS n FROM {{priced}} UNION ALL SELECT *, 1 AS n FROM {{priced}} WHERE ride_id % 9 = 0) v",
    # a failed payment is tried again; every sixty-first row is softly deleted
    "payment_transaction": "SELECT 2 * ride_id + n AS payment_transaction_id, ride_id, rider_id, rider_id AS payment_method_id, concat('Provider', CAST(rider_id % 5 AS STRING)) AS provider_name, concat('tx', CAST(2 * ride_id + n AS STRING)) AS provider_transaction_id, md5(CAST(2 * ride_id + n AS STRING)) AS idempotency_key, CAST(price AS DECIMAL(38,9)) AS amount, CAST(price * 0.01 AS DECIMAL(38,9)) AS method_fee, "
                           f"'idr' AS currency_code, CASE WHEN paid = 1 THEN 'paid' ELSE 'failed' END AS payment_status, CASE WHEN paid = 0 THEN CASE WHEN ride_id % 2 = 0 THEN 'card_declined' ELSE 'gateway_timeout' END END AS failure_code, CASE WHEN paid = 0 THEN 'payment was not made' END AS failure_message, completed_at AS authorized_at, CASE WHEN paid = 1 THEN completed_at END AS captured_at, "
                           f"CASE WHEN paid = 1 THEN {_minutes('completed_at', '1')} END AS paid_at, {_minutes('completed_at', 'n')} AS created_at, {_minutes('completed_at', '1 + 5 * n')} AS updated_at, CASE WHEN ride_id % 61 = 0 THEN {_minutes('completed_at', '60')} END AS deleted_at FROM (SELECT *, 0 AS n FROM {{priced}} UNION ALL SELECT *, 1 AS n FROM {{priced}} WHERE paid = 0) v",
    "payment_refund": f"SELECT ride_id AS refund_id, 2 * ride_id AS payment_transaction_id, ride_id, CAST(price * 0.5 AS DECIMAL(38,9)) AS refund_amount, 'service_quality' AS refund_reason_code, CASE WHEN ride_id % 2 = 0 THEN 'processed' ELSE 'requested' END AS refund_status, {_minutes('completed_at', '1440')} AS requested_at, CASE WHEN ride_id % 2 = 0 THEN {_minutes('completed_at', '3000 + ride_id % 99')} END AS processed_at, {_minutes('completed_at', '1440')} AS created_at, {_minutes('completed_at', '3100')} AS updated_at FROM {{priced}} WHERE paid = 1 AND ride_id % 31 = 0",
    "promo_usage": "SELECT ride_id AS promo_usage_id, promotion_id, ride_id, rider_id, CAST(off AS DECIMAL(38,9)) AS discount_amount_applied, completed_at AS used_at, completed_at AS created_at, completed_at AS updated_at FROM {priced} WHERE off > 0",
    "review": f"SELECT 2 * ride_id + n AS review_id, ride_id, 'rider' AS reviewer_type, rider_id AS reviewer_id, 'driver' AS reviewee_type, driver_id AS reviewee_id, 1 + ride_id % 5 AS rating_score, CASE WHEN ride_id % 7 = 0 THEN 'late' END AS comments, CASE WHEN ride_id % 8 = 0 THEN 'deleted' ELSE 'published' END AS review_status, {_minutes('completed_at', '60 + n')} AS created_at, {_minutes('completed_at', '60 + n')} AS updated_at, CASE WHEN ride_id % 23 = 0 THEN {_minutes('completed_at', '90')} END AS deleted_at "
              "FROM (SELECT *, 0 AS n FROM {priced} WHERE ride_id % 2 = 0 UNION ALL SELECT *, 1 AS n FROM {priced} WHERE ride_id % 6 = 0) v",
    "support_ticket": f"SELECT ride_id AS ticket_id, CASE WHEN ride_id % 11 <> 0 THEN ride_id END AS ride_id, rider_id, driver_id, 'service' AS ticket_category, CASE WHEN ride_id % 4 = 0 THEN 'open' ELSE 'resolved' END AS ticket_status, CASE WHEN ride_id % 5 = 0 THEN 'high' ELSE 'medium' END AS priority, {_minutes('updated_at', '120')} AS opened_at, CASE WHEN ride_id % 4 <> 0 THEN {_minutes('updated_at', '1800')} END AS resolved_at, {_minutes('updated_at', '120')} AS created_at, {_minutes('updated_at', '1800')} AS updated_at, CASE WHEN ride_id % 47 = 0 THEN {_minutes('updated_at', '1900')} END AS deleted_at FROM {{ride}} WHERE ride_id % 29 < 2",
}


#: The table that many others read, through a filter at most.
SHARED = ("ride",)


class StandIn:
    """The tables as DataFrames, each made when it is first asked for; nothing runs until an action. With a store, the shared ones are written there once."""

    def __init__(self, spark: SparkSession, sf_dir: str, store: Store | None = None):
        self.spark, self.sf_dir, self.made, self.store, self.lock = spark, sf_dir, {}, store, threading.RLock()

    def __getitem__(self, name: str) -> DataFrame:
        with self.lock:
            return self._table(name)

    def _table(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in SHARED and self.store is not None:
                if not self.store.exists(f"src_{name}"):
                    self.store.replace(f"src_{name}", self.spark.sql(VIEWS[name], **{x: self[x] for x in (*GIVEN, *VIEWS) if f"{{{x}}}" in VIEWS[name]}))
                self.made[name] = self.store.read(f"src_{name}")
            elif name in VIEWS:
                text = VIEWS[name]
                self.made[name] = self.spark.sql(text, **{x: self[x] for x in (*GIVEN, *VIEWS) if f"{{{x}}}" in text})
            else:
                self.made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.made[name]


def as_sql(name: str) -> str:
    """The SELECT of a table over plain names, in DuckDB's words."""
    text = VIEWS[name].replace(NAIVE, "TIMESTAMP")
    for x in (*GIVEN, *VIEWS):
        text = text.replace(f"{{{x}}}", x if x in GIVEN else f"src_{x}")
    return text

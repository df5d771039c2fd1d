"""Declared schemas of the operational tables, and casts directed by them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.functions.expressions import to_utc

#: Bronze types by the letter used in declarations; decimals widen to one type.
TYPES = {"L": T.LongType(), "S": T.StringType(), "B": T.BooleanType(), "N": T.DecimalType(38, 9), "T": T.TimestampNTZType(), "D": T.DateType()}
METADATA = ("_ingested_at", "_source_system")


def parse_schema(text: str) -> T.StructType:
    """'ride_id:L! rider_id:L city_code:S' as a StructType; '!' marks columns that are never null."""
    fields = []
    for item in text.split():
        name, _, kind = item.partition(":")
        fields.append(T.StructField(name, TYPES[kind.rstrip("!")], not kind.endswith("!")))
    return T.StructType(fields)


@dataclass(frozen=True)
class TableConfig:
    """How one operational table is ingested. Window, version and partition columns are set apart, as an immutable
    column makes a useless version; the version is updated_at unless said otherwise."""

    name: str
    keys: tuple[str, ...]
    schema: T.StructType
    window_col: str = "updated_at"
    version_col: str | None = "updated_at"
    partition_col: str = "updated_at"
    unit: str = "month"
    cluster: tuple[str, ...] = ()
    append_only: bool = False
    strict: bool = True
    source_zone: str | None = None
    source_system: str = "ride_ops_pg"
    columns: tuple[str, ...] = ()
    json_columns: tuple[str, ...] = ()

    def __post_init__(self):
        names = set(self.schema.names)
        if not self.keys:
            raise ValueError(f"{self.name}: no merge key")
        chosen = self.columns or tuple(self.schema.names)
        if unknown := [c for c in (*self.keys, *chosen) if c not in names]:
            raise ValueError(f"{self.name}: unknown columns {unknown}")
        if meta := [c for c in chosen if c in METADATA]:
            raise ValueError(f"{self.name}: metadata columns {meta} are added by the engine")
        if len(self.cluster) > 4:
            raise ValueError(f"{self.name}: more than four cluster columns")

    @property
    def selected(self) -> tuple[str, ...]:
        return self.columns or tuple(self.schema.names)


def cast_columns(df: DataFrame, config: TableConfig) -> list[Column]:
    """The selected columns cast to the declared types; naive times of another zone become UTC; JSON becomes text."""
    out = []
    for name in config.selected:
        kind, col = config.schema[name].dataType, df[name]
        if name in config.json_columns and not isinstance(df.schema[name].dataType, T.StringType):
            col = F.to_json(col)
        elif isinstance(kind, T.TimestampNTZType):
            col = to_utc(col.cast(kind), config.source_zone)
        out.append(col.cast(kind).alias(name))
    return out


_PG = dict(source_system="ride_ops_pg", unit="month", strict=True)
_MY = dict(source_system="billing_growth_db", unit="day", strict=False, source_zone="Asia/Jakarta")
_EVENT = dict(append_only=True, version_col=None)
_AGE = "created_at:T! updated_at:T!"
_SOFT = _AGE + " deleted_at:T"


def _table(name: str, key: str, columns: str, cluster: str, base: dict, **more) -> TableConfig:
    return TableConfig(name, (key,), parse_schema(f"{key}:L! {columns}"), cluster=tuple(cluster.split()), **(base | more))


TABLES = {
    t.name: t
    for t in (
        _table("rider_account", "rider_id", f"username:S! full_name:S email:S phone_number:S account_status:S! city_code:S! {_SOFT}", "city_code account_status", _PG),
        _table("driver_profile", "driver_id", f"driver_name:S! phone_number:S city_code:S! driver_status:S! verification_status:S! rating_avg:N! rating_count:L! {_SOFT}", "city_code driver_status verification_status", _PG),
        _table("vehicle", "vehicle_id", f"driver_id:L license_plate:S! vehicle_type:S! vehicle_make:S vehicle_model:S vehicle_year:L vehicle_status:S! {_SOFT}", "driver_id vehicle_type vehicle_status", _PG),
        _table("driver_vehicle_assignment", "assignment_id", f"driver_id:L! vehicle_id:L! assigned_from:T! assigned_to:T is_active:B! {_AGE}", "driver_id vehicle_id is_active", _PG),
        _table("driver_shift", "shift_id", f"driver_id:L! shift_status:S! started_at:T! ended_at:T {_AGE}", "driver_id shift_status", _PG),
        _table("ride", "ride_id", "rider_id:L! driver_id:L vehicle_id:L ride_status:S! service_type:S! city_code:S! requested_at:T! accepted_at:T arrived_at:T started_at:T completed_at:T cancelled_at:T "
               f"cancelled_by_type:S cancel_reason_code:S estimated_distance_km:N estimated_duration_min:N {_SOFT}", "city_code ride_status service_type", _PG),
        _table("ride_status_history", "ride_status_history_id", "ride_id:L! old_status:S new_status:S! changed_by_type:S! changed_by_id:L reason_code:S reason_note:S changed_at:T! created_at:T!", "ride_id new_status changed_by_type", _PG, window_col="changed_at", partition_col="changed_at", **_EVENT),
        _table("ride_location", "ride_location_id", "ride_id:L! location_type:S! latitude:N! longitude:N! address_text:S captured_at:T! created_at:T!", "ride_id location_type", _PG, window_col="captured_at", partition_col="captured_at", **_EVENT),
        _table("ride_tracking_point", "tracking_point_id", "ride_id:L! driver_id:L! latitude:N! longitude:N! speed_kmh:N recorded_at:T! created_at:T!", "ride_id driver_id", _PG, window_col="recorded_at", partition_col="recorded_at", **_EVENT),
        _table("ride_fare", "fare_id", "ride_id:L! fare_type:S! fare_version:L! currency_code:S! distance_km:N duration_min:N base_fare:N distance_fare:N time_fare:N surge_multiplier:N surge_amount:N discount_amount:N "
               f"tax_amount:N platform_fee:N driver_earning:N total_fare:N fare_rule_code:S is_corrected:B! calculated_at:T! {_AGE}", "ride_id fare_type is_corrected", _PG),
        _table("payment_method", "payment_method_id", f"rider_id:L! method_code:S! provider_name:S! masked_account:S payment_method_status:S! is_default:B! {_SOFT}", "rider_id method_code payment_method_status", _MY),
        _table("payment_transaction", "payment_transaction_id", "ride_id:L! rider_id:L! payment_method_id:L provider_name:S! provider_transaction_id:S idempotency_key:S! amount:N! method_fee:N! currency_code:S! payment_status:S! "
               f"failure_code:S failure_message:S authorized_at:T captured_at:T paid_at:T {_SOFT}", "ride_id payment_status provider_name", _MY),
        _table("payment_refund", "refund_id", f"payment_transaction_id:L! ride_id:L! refund_amount:N! refund_reason_code:S refund_status:S! requested_at:T! processed_at:T {_AGE}", "ride_id refund_status", _MY),
        _table("promotion", "promotion_id", f"promo_code:S promo_description:S discount_type:S! discount_pct:N discount_amount:N max_discount_amount:N min_fare_amount:N valid_from:T! valid_to:T! promotion_status:S! {_SOFT}", "promo_code promotion_status", _MY),
        _table("promo_usage", "promo_usage_id", f"promotion_id:L! ride_id:L! rider_id:L! discount_amount_applied:N! used_at:T! {_AGE}", "promotion_id ride_id", _MY),
        _table("review", "review_id", f"ride_id:L! reviewer_type:S! reviewer_id:L! reviewee_type:S! reviewee_id:L! rating_score:L! comments:S review_status:S! {_SOFT}", "ride_id review_status rating_score", _MY),
        _table("support_ticket", "ticket_id", f"ride_id:L rider_id:L driver_id:L ticket_category:S! ticket_status:S! priority:S! opened_at:T! resolved_at:T {_SOFT}", "ticket_status priority ticket_category", _MY),
    )
}
#: The one composite key: roles of a user.
USER_ROLE = TableConfig("user_role", ("user_id", "role_id"), parse_schema("user_id:L! role_id:L! assigned_at:T! assigned_by:L is_active:B!"), window_col="assigned_at", version_col="assigned_at", partition_col="assigned_at")

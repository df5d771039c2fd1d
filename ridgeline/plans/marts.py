"""The warehouse models as a graph of DataFrame functions: staging, intermediate, dimensions, facts, aggregates.

A model takes a Session (which resolves sources and other models) and returns a DataFrame; nothing runs until an action,
so Catalyst sees each mart as one plan. Timestamps are naive UTC.
"""

from __future__ import annotations

import atexit
import datetime as dt
import uuid
from collections.abc import Callable, Collection, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.functions import expressions as X
from ridgeline.functions.schema import TABLES
from ridgeline.operators.funnel import funnel_steps
from ridgeline.operators.history import FEW, as_of_join, as_of_piles, latest_by, scd2_apply, scd2_from_history, version_counts
from ridgeline.operators.incremental import FIRST_DAY, run_model
from ridgeline.operators.snapshots import history as kept_history
from ridgeline.operators.snapshots import snapshot
from ridgeline.operators.store import Store, shared_folder, write_query
from ridgeline.plans.stand_in import BUILT, SECOND, StandIn
from ridgeline.sources import datagen
from ridgeline.sources.spine import date_dimension

MODELS: dict[str, Callable[[Session], DataFrame]] = {}
#: Facts that can be asked for some columns.
FACTS: dict[str, Callable[[Session, Collection[str] | None], DataFrame]] = {}
#: The column that says when a row was built.
LOADED = "_dbt_loaded_at"
#: Most keys of a dimension that is broadcast.
SMALL = 400_000
#: Most versions of a key that go with a payment, or a promotion's use, to its ride.
CARRIED = 4


def is_view(name: str) -> bool:
    """Staging and intermediate models are computed where they are read."""
    return name.startswith(("stg_", "int_"))


class Session:
    """Resolves tables and models by name, each built once.

    now: the time that models are marked with. store: where materialised models lie; `ref` then reads them there.
    since: for a model that is built for some days only, its first day and the column that holds it. lean: facts that aren't
    stored are computed with the columns that are read of them alone (`part`). doubles: decimals of a whole fact may be doubles.
    """

    def __init__(self, spark: SparkSession, sources: Bronze | StandIn | dict[str, DataFrame], now: Column | None = None, store: Store | None = None, lean: bool = False, doubles: bool = False):
        self.spark, self.sources, self.built, self.lineage, self.lean, self.doubles = spark, sources, {}, [], lean, doubles
        self.now, self.store, self.since, self.counts = F.expr("cast(current_timestamp() as timestamp_ntz)") if now is None else now, store, {}, {}

    def source(self, name: str) -> DataFrame:
        return self.sources[name]

    def recent(self, model: str, rows: DataFrame, day: Column) -> DataFrame:
        """The rows from the first day that an increment of the model covers; all of them in a full build."""
        return rows.filter(day >= F.lit(self.since[model])) if model in self.since else rows

    def ref(self, name: str) -> DataFrame:
        outer = getattr(self, "path", ())
        if name in outer:
            raise ValueError(f"models depend on each other: {' > '.join((*outer, name))}")
        if outer:
            self.lineage.append((name, outer[-1]))
        if name not in self.built:
            stored = outer and self.store is not None and not is_view(name) and self.store.exists(name)
            self.path = (*outer, name)
            self.built[name] = self.store.read(name) if stored else MODELS[name](self)
            self.path = outer
        return self.built[name]

    def part(self, name: str, columns: Sequence[str]) -> DataFrame:
        """Columns of a fact, as many rows as it has: of its table, or in a lean session without the joins that neither they nor the number of rows need."""
        if not self.lean or self.store is not None and self.store.exists(name):
            return self.ref(name).select(*columns)
        return FACTS[name](self, frozenset(columns)).select(*columns)

    def versions(self, looks: Collection[tuple[str, str]]) -> list[tuple[DataFrame, int, int]]:
        """What lookups read of dimensions, given with their keys, and how many keys they have and versions the key with most.

        In a lean session, dimensions that aren't stored are stored as key, validity and surrogate key alone. Where there is no
        table to count they are taken to have many versions a key.
        """
        def one(look: tuple[str, str]) -> tuple[DataFrame, int, int] | None:
            dim, key = look
            if dim in self.counts:
                return self.counts[dim]
            if self.store is None or not self.store.exists(f"dim_{dim}") and not (self.lean and isinstance(self.sources, StandIn)):
                return None
            if self.store.exists(f"dim_{dim}"):
                return None, *version_counts(self.store.read(f"dim_{dim}"), key)
            if not self.store.exists(f"keys_{dim}"):
                self.store.replace(f"keys_{dim}", _versions_alone(self, dim))
            rows = self.store.read(f"keys_{dim}")
            return rows, *version_counts(rows, key)

        with ThreadPoolExecutor(4) as threads:
            held = list(threads.map(one, looks))
        for x, (dim, _) in zip(held, looks, strict=True):
            self.counts[dim] = x if x and x[0] is not None else (self.ref(f"dim_{dim}"), *(x[1:] if x else (0, FEW + 1)))
        return [self.counts[dim] for dim, _ in looks]


def model(f: Callable) -> Callable:
    MODELS[f.__name__] = f
    return f


def fact(f: Callable) -> Callable:
    FACTS[f.__name__], MODELS[f.__name__] = f, f
    return f


_BRONZE: dict[tuple[str, int], Bronze] = {}


class Bronze:
    """Generated tables, each written to the shared folder when it is first asked for, so models scan stored columns."""

    def __init__(self, spark: SparkSession, rides: int):
        self.spark, self.made = spark, datagen.tables(spark, rides)
        self.root, self.read = f"{shared_folder(spark)}/bronze-{uuid.uuid4().hex}", {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.read:
            path = f"{self.root}/{name}"
            write_query(self.made[name], path)
            self.read[name] = self.spark.read.schema(self.made[name].schema).parquet(path)
        return self.read[name]


_KEPT: dict[tuple[str, str], tuple[StandIn, Store]] = {}


def kept(spark: SparkSession, sf_dir: str) -> tuple[StandIn, Store]:
    """The operational tables that stand in for sf_dir's, and a store for its models; both last as long as the application."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _KEPT:
        store = Store(spark, f"{shared_folder(spark)}/models-{uuid.uuid4().hex}")
        atexit.register(lambda: spark.sparkContext._jsc and store.drop(""))
        _KEPT[key] = StandIn(spark, sf_dir, store), store
    return _KEPT[key]


def build(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A model over the operational tables that stand in for sf_dir's; decimals as doubles.

    Dimensions are built once and stored; of those that a fact looks keys up in, the columns that it needs for that alone. The
    model, and the columns that it reads of facts, are computed: an aggregate doesn't pay for lookups and columns that it doesn't
    read, nor depends on what was built before it.
    """
    from ridgeline.plans.runner import run_models

    (sources, store), now = kept(spark, sf_dir), F.expr(f"TIMESTAMP_NTZ '{BUILT}'")
    if name not in FACTS:
        plain = Session(spark, sources, now, lean=True)
        plain.ref(name)
        first = {x for x, _ in plain.lineage if x.startswith("dim_") or x.removeprefix("stg_") in _SNAPSHOTS} | ({name} if is_view(name) else set())
        run = run_models(spark, sources, store, sorted(first), now=now, only_absent=True, whole=True) if first else None
        if run and run.errors:
            raise RuntimeError(f"{name}: {run.errors}")
    made = Session(spark, sources, now, store, lean=True, doubles=True).ref(name)
    return made.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name) for f in made.schema])


def build_generated(spark: SparkSession, rides: int, name: str) -> DataFrame:
    """A model over as many generated rides."""
    key = spark.sparkContext.applicationId, rides
    if key not in _BRONZE:
        _BRONZE[key] = Bronze(spark, rides)
    return Session(spark, _BRONZE[key]).ref(name)


#: Models that are kept and built by increments: strategy, key, partition, and the days that an increment looks back, from the
#: table's last day (merge) or from today (insert_overwrite).
MATERIALISED = {
    "fct_rides": ("merge", "ride_sk", "requested_date", 3),
    "fct_payments": ("merge", "payment_transaction_sk", "payment_date", 3),
    "fct_refunds": ("merge", "refund_sk", "refund_date", 3),
    "fct_support_tickets": ("merge", "ticket_sk", "opened_date", 3),
    **{f"agg_{x}": ("insert_overwrite", "", "metric_date", 7) for x in ("daily_city_service", "daily_payment_method", "daily_refunds", "driver_performance_daily", "promo_performance_daily", "ride_funnel_steps_daily")},
}


def _outside(col: str, low, high) -> Column:
    return F.col(col).isNotNull() & ~F.col(col).between(low, high)


def _checks() -> dict[str, dict[str, Column]]:
    """What no row of a model may be, by the model's name; a version with such a row isn't published."""
    absent = lambda *cols: {f"not_null_{c}": F.col(c).isNull() for c in cols}
    return {
        **{f"dim_{x}": absent(f"{x}_sk", f"{x}_id") for x in ("rider", "driver", "vehicle")},
        **{f"dim_{x}": absent(f"{x}_sk") for x in ("payment_method", "promotion")},
        "fct_rides": {**absent("ride_sk"), "total_fare_not_negative": F.col("total_fare") < 0},
        "fct_payments": {**absent("payment_transaction_sk"), "accepted_payment_status": F.col("payment_status").isNotNull() & ~F.col("payment_status").isin("PAID", "FAILED")},
        "agg_daily_city_service": {"completion_rate_between": _outside("completion_rate", 0, 1)},
    }


def materialise(spark: SparkSession, sources, store: Store, name: str, today: dt.date | None = None, now: Column | None = None, full_refresh: bool = False, whole: bool = False) -> DataFrame:
    """Builds a model, for its recent days if it is kept by increments, applies that to its table, and gives the table.

    The first day is read before, so that it is a literal that reaches the scans. Facts look back from their own last day and
    are merged; aggregates look back from `today` (None: all days) and replace whole days, reading the kept facts. The first
    build, and a full refresh, cover all days. With `whole` any model is built whole, into a table without partitions. The model's
    checks are counted as it is written.
    """
    strategy, key, partition, days = ("full", "", None, 0) if whole else MATERIALISED.get(name, ("full", "", None, 0))
    session, checks = Session(spark, sources, now, store), _checks().get(name)
    if strategy != "full" and store.exists(name) and not full_refresh:
        last = (store.read(name).agg(F.max(partition)).first()[0] or FIRST_DAY) if strategy == "merge" else today
        if last is not None:
            session.since[name] = last - dt.timedelta(days=days)
    return run_model(store, name, session.ref(name), strategy, [key], partition, full_refresh or strategy == "full", checks)


def keep_snapshots(sources, store: Store, names) -> None:
    """Takes the states of the entities that the named staging models read into their kept histories."""
    for table, (key, _) in _SNAPSHOTS.items():
        if f"stg_{table}" in names and isinstance(sources, StandIn):
            for k in (1, 2):  # the first state is only taken into a history that isn't there
                if k == 2 and len(store._versions(f"snap_{table}")) > 1:
                    continue
                if k == 2 or not store.exists(f"snap_{table}"):
                    snapshot(store, f"snap_{table}", sources[f"{table}_{k}"].withColumnsRenamed(_RENAMED.get(table, {})), key, "updated_at", F.expr(f"TIMESTAMP_NTZ '{SECOND}'"))


#: Columns whose text is stored in one case.
UPPER = frozenset(
    "account_status city_code driver_status verification_status license_plate vehicle_type vehicle_status ride_status service_type cancelled_by_type cancel_reason_code fare_type currency_code fare_rule_code shift_status old_status new_status "
    "changed_by_type reason_code location_type method_code payment_method_status payment_status failure_code refund_reason_code refund_status promo_code discount_type promotion_status reviewer_type reviewee_type review_status ticket_category ticket_status priority".split()
)
LOWER = frozenset(("provider_name",))


def staged(df: DataFrame, table: str, renamed: dict[str, str] | None = None) -> list[Column]:
    """The declared columns, cast, in one case, renamed; with is_deleted where rows can be deleted softly."""
    out = []
    for field in TABLES[table].schema:
        col = df[field.name].cast(field.dataType)
        col = F.upper(col) if field.name in UPPER else F.lower(col) if field.name in LOWER else col
        out.append(col.alias((renamed or {}).get(field.name, field.name)))
    if "deleted_at" in TABLES[table].schema.names:
        out.append(df["deleted_at"].isNotNull().alias("is_deleted"))
    return out


def _two_states(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The history of two snapshots, the second at SECOND."""
    none = F.lit(None).cast("timestamp_ntz")
    history = first.filter(F.lit(False)).select("*", F.lit("").alias("scd_id"), none.alias("valid_from"), none.alias("valid_to"))
    for state in (first, second):
        history = scd2_apply(history, state, key, "updated_at", F.expr(f"TIMESTAMP_NTZ '{SECOND}'"))
    return history


def _dim_key(key: Column, begin: Column) -> Column:
    """The surrogate key of a dimension's version; it follows from key and begin, so lookups deal those out, not the text."""
    return X.surrogate_key(key, begin)


def _versions_alone(s: Session, dim: str) -> DataFrame:
    """Key, validity and surrogate key of a dimension: of both states only what these follow from is read and joined."""
    table, key = next((t, k) for t, (k, prefix) in _SNAPSHOTS.items() if prefix == dim)
    states = (s.source(f"{table}_{k}").select(F.col(key).cast(TABLES[table].schema[key].dataType).alias(key), "updated_at") for k in (1, 2))
    return _two_states(*states, key).select(key, "valid_from", "valid_to", _dim_key(F.col(key), F.col("valid_from")).alias(f"{dim}_sk"))


def _snapshot(s: Session, table: str, key: str, prefix: str, renamed: dict[str, str] | None = None) -> DataFrame:
    """A staged SCD2 history: snapshot id, declared columns, validity, is_current."""
    if s.store is not None and s.store.exists(f"snap_{table}"):
        history = kept_history(s.store, f"snap_{table}").withColumnsRenamed({"valid_from": "_from", "valid_to": "_to"})
    elif isinstance(s.sources, StandIn):
        history = _two_states(*(s.source(f"{table}_{k}").withColumnsRenamed(renamed or {}) for k in (1, 2)), key).withColumnsRenamed({"valid_from": "_from", "valid_to": "_to"})
    else:
        history = scd2_from_history(s.source(table).withColumnsRenamed(renamed or {}), key, "updated_at").withColumnsRenamed({"valid_from": "_from", "valid_to": "_to"})
    back = history.withColumnsRenamed({v: k for k, v in (renamed or {}).items()})
    return back.select(F.md5(F.concat_ws("|", key, "updated_at")).alias(f"{prefix}_snapshot_id"), *staged(back, table, renamed), F.col("_from").alias("valid_from"), F.col("_to").alias("valid_to"), F.col("_to").isNull().alias("is_current"))


_SNAPSHOTS = {"rider_account": ("rider_id", "rider"), "driver_profile": ("driver_id", "driver"), "vehicle": ("vehicle_id", "vehicle"), "driver_vehicle_assignment": ("assignment_id", "assignment"), "payment_method": ("payment_method_id", "payment_method"), "promotion": ("promotion_id", "promotion")}
_RENAMED = {"promotion": {"valid_from": "promo_valid_from", "valid_to": "promo_valid_to"}}
for _name, (_key, _prefix) in _SNAPSHOTS.items():
    MODELS[f"stg_{_name}"] = lambda s, t=_name, k=_key, p=_prefix: _snapshot(s, t, k, p, _RENAMED.get(t))
for _name in TABLES:
    if _name not in _SNAPSHOTS and _name != "ride":
        MODELS[f"stg_{_name}"] = lambda s, t=_name: s.source(t).select(*staged(s.source(t), t))


@model
def stg_ride(s: Session) -> DataFrame:
    raw = s.source("ride")
    at = raw["requested_at"]
    flags = {"is_completed": "COMPLETED", "is_cancelled": "CANCELLED", "is_payment_failed": "PAYMENT_FAILED"}
    return raw.select(
        *staged(raw, "ride"), X.local_date(at).alias("requested_date"), X.local_hour(at).alias("requested_hour"), X.is_weekend(at).alias("is_weekend"), X.is_peak(at).alias("is_peak_hour"),
        *[(raw["ride_status"] == v).alias(k) for k, v in flags.items()],
    )


@model
def int_ride_lifecycle(s: Session) -> DataFrame:
    spans = {"accept_delay_min": ("requested_at", "accepted_at"), "driver_arrival_min": ("accepted_at", "arrived_at"), "pickup_wait_min": ("arrived_at", "started_at"), "actual_ride_duration_min": ("started_at", "completed_at")}
    outcome = F.when(F.col("is_completed"), "completed").when(F.col("is_cancelled"), "cancelled").when(F.col("is_payment_failed"), "payment_failed").otherwise("incomplete")
    return s.ref("stg_ride").filter(~F.col("is_deleted")).withColumns({k: X.minutes_between(F.col(a), F.col(b)) for k, (a, b) in spans.items()} | {"lifecycle_outcome": outcome})


@model
def int_ride_financials(s: Session) -> DataFrame:
    joined, parts = _joined_rides(s, None)
    return joined.select("ride_id", *[f"{part}.*" for part in parts])


def _joined_rides(s: Session, wanted: list[str] | None, whole: bool = False, carried: Collection[str] = ()) -> tuple[DataFrame, dict[str, list[str]]]:
    """Rides with their fare, payment and promotion, each as one struct of the wanted columns (None: all), and the columns of each.

    carried: of payment_method and promotion, those whose versions come along as `_versions_<dimension>` (`_carry`).
    With `whole`, decimals may be doubles (24 bytes less a value, in rows that are dealt out and sorted), as nothing is computed of them.
    Fares and payments of which nothing is wanted are left out, as a ride has one at most; promotions keep their ride_id, by which
    a ride that used two is two rows.

    Tens of columns that pass through joins one by one make methods that the JVM doesn't compile; structs are one column each.
    """
    plainer = _as_doubles if s.doubles and whole else lambda df: df
    newest = [F.col("updated_at").desc()]
    fare = latest_by(plainer(s.ref("stg_ride_fare")), ["ride_id"], [F.col("fare_version").desc(), *newest, F.col("fare_id").desc()])
    fare = fare.select("ride_id", "fare_id", "distance_km", "duration_min", "base_fare", "distance_fare", "time_fare", "surge_multiplier", "surge_amount", "discount_amount", "tax_amount", "platform_fee", "driver_earning", "total_fare")
    rides = s.recent("fct_rides", s.ref("int_ride_lifecycle"), F.col("requested_date")) if wanted else s.ref("int_ride_lifecycle")
    dims = {"_paid": "payment_method", "_promo": "promotion"}
    along = {part: [f"_versions_{x}"] if x in carried else [] for part, x in dims.items()}
    tables = {"_ride": plainer(rides.drop("created_at", "updated_at", "deleted_at", "is_deleted")), "_fare": fare, "_paid": _last_paid(s, plainer, "payment_method" in carried), "_promo": plainer(_carry(s, _used_promo(s), "promotion") if "promotion" in carried else _used_promo(s))}
    parts = {part: [c for c in t.columns if c != "ride_id" and c not in along.get(part, ()) and (wanted is None or c in wanted)] for part, t in tables.items()}
    parts = {part: columns for part, columns in parts.items() if columns or part in ("_ride", "_promo")}
    packed = [tables[part].select("ride_id", *([F.struct(*columns).alias(part)] if columns else []), *along.get(part, ())) for part, columns in parts.items()]
    joined = packed[0]
    for t in packed[1:]:
        joined = joined.join(t, "ride_id", "left")
    return joined, parts


def _as_doubles(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.col(f.name).cast("double") for f in df.schema if isinstance(f.dataType, T.DecimalType)})


def _carry(s: Session, rows: DataFrame, dim: str) -> DataFrame:
    """The rows with all versions of their key, for dimensions of few versions a key: which one counts is told where the time is known (`_told`).

    Rows are joined on the key alone; those without one are spread, as they match nothing.
    """
    key, begin, end = F.col(f"{dim}_id"), F.col("valid_from"), F.col("valid_to")
    versions, _, most = s.versions([(dim, f"{dim}_id")])[0]
    version = F.struct(begin.alias("_from"), end.isNull().alias("_open"), end.alias("_to"))
    piles = versions.filter(key.isNotNull() & begin.isNotNull()).select(key.alias("_dim"), version.alias("_v")).groupBy("_dim").agg(F.collect_list("_v").alias(f"_versions_{dim}"))
    spread = F.coalesce(key, -1 - F.pmod(F.xxhash64("ride_id"), F.lit(1 << 12)) - (1 << 40))
    return rows.withColumn("_key", spread).join(piles, (F.col("_key") == F.col("_dim")) & key.isNotNull(), "left").drop("_key", "_dim")


def _told(s: Session, dim: str, at: Column) -> Column:
    """The surrogate key of the version that was valid at a time, of those that `_carry` gave."""
    held = [F.get(F.col(f"_versions_{dim}"), F.lit(k)) for k in range(s.counts[dim][2])]
    begun = [F.when(v["_from"] <= at, v) for v in held]
    last = F.greatest(*begun) if len(begun) > 1 else begun[0]
    return F.when(last["_open"] | (at < last["_to"]), _dim_key(F.col(f"{dim}_id"), last["_from"]))


def _last_paid(s: Session, plainer: Callable[[DataFrame], DataFrame] = lambda df: df, carried: bool = False) -> DataFrame:
    rows = plainer(s.ref("stg_payment_transaction")).filter(~F.col("is_deleted"))
    paid = latest_by(_carry(s, rows, "payment_method") if carried else rows, ["ride_id"], [F.col("updated_at").desc(), F.col("payment_transaction_id").desc()])
    return paid.select("ride_id", "payment_transaction_id", "payment_method_id", "payment_status", "failure_code", F.col("amount").alias("payment_amount"), F.col("method_fee").alias("payment_method_fee"), "paid_at", *(["_versions_payment_method"] if carried else []))


def _used_promo(s: Session) -> DataFrame:
    return s.ref("stg_promo_usage").select("ride_id", "promotion_id", F.col("discount_amount_applied").alias("promo_discount_amount"), F.col("used_at").alias("promo_used_at"))


@model
def int_customer_feedback(s: Session) -> DataFrame:
    """Latest published review and latest ticket of each ride. Tickets without a ride share the null key, so one of them is left."""
    newest = F.col("updated_at").desc()
    review = latest_by(s.ref("stg_review").filter(~F.col("is_deleted") & (F.col("review_status") == "PUBLISHED")), ["ride_id"], [newest, F.col("review_id").desc()])
    ticket = latest_by(s.ref("stg_support_ticket").filter(~F.col("is_deleted")), ["ride_id"], [newest, F.col("ticket_id").desc()])
    left = review.select("ride_id", "review_id", "rating_score", "comments", F.col("created_at").alias("reviewed_at"))
    right = ticket.select("ride_id", "ticket_id", "ticket_category", "ticket_status", "priority", "opened_at", "resolved_at")
    return left.join(right, "ride_id", "full").withColumn("ticket_resolution_min", X.minutes_between(F.col("opened_at"), F.col("resolved_at")))


def _dim(s: Session, staging: str, key: str, name: str, with_date: bool = True) -> DataFrame:
    rows = s.ref(staging)
    made = [F.to_date("created_at").alias(f"{name}_created_date")] if with_date else []
    drop = ("deleted_at",)
    return rows.select(_dim_key(F.col(key), F.col("valid_from")).alias(f"{name}_sk"), *[c for c in rows.columns if c not in drop], *made)


for _staging, (_key, _prefix) in _SNAPSHOTS.items():
    _dim_name = "dim_driver_vehicle_assignment" if _prefix == "assignment" else f"dim_{_prefix}"
    MODELS[_dim_name] = lambda s, t=_staging, k=_key, p=_prefix: _dim(s, f"stg_{t}", k, p, p != "assignment")
MODELS["dim_date"] = lambda s: date_dimension(s.spark)

_RIDE_COLUMNS = (
    "rider_id driver_id vehicle_id payment_method_id promotion_id payment_transaction_id fare_id city_code service_type ride_status lifecycle_outcome requested_date requested_at accepted_at arrived_at started_at completed_at cancelled_at cancelled_by_type "
    "cancel_reason_code is_completed is_cancelled is_payment_failed is_weekend is_peak_hour requested_hour estimated_distance_km estimated_duration_min distance_km duration_min accept_delay_min driver_arrival_min pickup_wait_min actual_ride_duration_min base_fare "
    "distance_fare time_fare surge_multiplier surge_amount discount_amount tax_amount platform_fee driver_earning total_fare payment_status failure_code payment_amount payment_method_fee promo_discount_amount"
).split()


def _with_keys(s: Session, rows: DataFrame, by: Column, looks: list[tuple[str, str, Column, DataFrame | None]]) -> DataFrame:
    """The rows, once each, with `_by` and the surrogate keys of dimensions that were valid at a time.

    looks: dimension, its key, the time, and a narrower table that holds `by` and all pairs of key and time of the rows (None: the
    rows). Small dimensions are broadcast. For large ones `by`, key and time alone go to the versions, and come back with the begin of
    the version that counts, from which its surrogate key follows; so the rows' many columns are dealt once, by `by`. Where a key has
    many versions, or the dimensions aren't stored yet and so aren't counted, facts and versions are swept together.
    """
    held, lost, found, before = [], [], [], rows
    counted = s.versions([(dim, key) for dim, key, *_ in looks])
    for k, ((dim, key, at, asks), (versions, keys, most)) in enumerate(zip(looks, counted, strict=True)):
        sk = f"{dim}_sk"
        if most > FEW:
            lost.append((versions, key, at, sk))
        elif keys <= SMALL:
            held.append((versions, key, at, sk))
        else:
            asked = (rows if asks is None else asks).select(by.alias("_by"), key, at.alias("_time")).filter(F.col("_by").isNotNull() & F.col(key).isNotNull() & F.col("_time").isNotNull())
            got = as_of_piles(asked, versions.withColumn("_begin", F.col("valid_from")), key, F.col("_time"), ["_begin"])
            found.append((key, at, sk, got.filter(F.col("_begin").isNotNull()).select(F.col("_by").alias(f"_by{k}"), F.col(key).alias(f"_key{k}"), F.col("_time").alias(f"_time{k}"), F.col("_begin").alias(f"_begin{k}")), k))
    for versions, key, at, sk in lost:
        rows = as_of_join(rows, versions, key, at, [sk], seen=before)
    rows = rows.withColumn("_by", by)
    for key, at, sk, got, k in found:
        # dealt by `by` alone, as the rows are: key and time are told apart within it (two bounds, as an equality would be dealt by, too)
        once, same = got.repartition(f"_by{k}").distinct(), lambda a, b: (a <= b) & (a >= b)
        rows = rows.join(once, (F.col("_by") == F.col(f"_by{k}")) & same(F.col(key), F.col(f"_key{k}")) & same(at, F.col(f"_time{k}")), "left")
        rows = rows.withColumn(sk, F.when(F.col(f"_by{k}").isNotNull(), _dim_key(F.col(key), F.col(f"_begin{k}")))).drop(f"_by{k}", f"_key{k}", f"_time{k}", f"_begin{k}")
    for versions, key, at, sk in held:
        rows = as_of_piles(rows, versions, key, at, [sk], small=True)
    return rows


#: Columns of a ride's review and ticket.
_SEEN = ("review_id", "rating_score", "ticket_id", "ticket_category", "ticket_status", "priority")


@fact
def fct_rides(s: Session, wanted: Collection[str] | None = None) -> DataFrame:
    """Rides with the surrogate keys that were valid at the time that counts for each dimension; with all columns, or those that are wanted and ride_id."""
    taken, paid, used = F.coalesce("accepted_at", "requested_at"), F.coalesce("paid_at", "completed_at", "requested_at"), F.coalesce("promo_used_at", "completed_at", "requested_at")
    times = {"rider": ["requested_at"], "driver": ["accepted_at", "requested_at"], "vehicle": ["accepted_at", "requested_at"], "payment_method": ["paid_at", "completed_at", "requested_at"], "promotion": ["promo_used_at", "completed_at", "requested_at"]}
    want = lambda *columns: [c for c in columns if wanted is None or c in wanted]
    dims, columns, seen = [x for x in times if want(f"{x}_sk")], want(*_RIDE_COLUMNS), want(*_SEEN)
    asked = sorted({c for x in dims for c in (f"{x}_id", *times[x])})
    counted = dict(zip(dims, s.versions([(x, f"{x}_id") for x in dims]), strict=True))
    carried = [x for x in ("payment_method", "promotion") if x in counted and counted[x][1] > SMALL and counted[x][2] <= CARRIED]
    plain = s.recent("fct_rides", s.ref("int_ride_lifecycle"), F.col("requested_date"))
    if not columns and not asked:
        rides, place = plain.select("ride_id").join(_used_promo(s).select("ride_id"), "ride_id", "left"), {}
    else:
        rides, parts = _joined_rides(s, [*columns, *asked], wanted is None, carried)
        place = {c: F.col(f"{part}.{c}") for part, held in parts.items() for c in held}
        rides = rides.select("ride_id", *[part for part, held in parts.items() if held], *[place[c].alias(c) for c in asked], *[f"_versions_{x}" for x in carried])
    # which rides ask for a dimension of what they paid with or used
    at = {"rider": (F.col("requested_at"), lambda: plain), "driver": (taken, lambda: plain), "vehicle": (taken, lambda: plain), "payment_method": (paid, lambda: plain.join(_last_paid(s), "ride_id")), "promotion": (used, lambda: plain.join(_used_promo(s), "ride_id"))}
    rides = _with_keys(s, rides, F.col("ride_id"), [(x, f"{x}_id", at[x][0], at[x][1]()) for x in dims if x not in carried])
    rides = rides.withColumns({f"{x}_sk": _told(s, x, at[x][0]) for x in carried}) if carried else rides
    if seen:
        feedback = s.ref("int_customer_feedback").select(F.col("ride_id").alias("_by"), F.struct(*seen).alias("_seen"))
        rides = rides.join(feedback, "_by", "left")
    made = [F.col(f"{x}_sk") for x in dims] + [place[c].alias(c) for c in columns] + [F.col(f"_seen.{c}").alias(c) for c in seen]
    return rides.select(*[X.surrogate_key(F.col("ride_id")).alias(c) for c in want("ride_sk")], "ride_id", *made, *[s.now.alias(c) for c in want(LOADED)])


def _ride_ids(s: Session) -> DataFrame:
    """The rides that the facts hold, as `_ride`. Their surrogate keys follow from it, so those aren't shuffled."""
    return s.part("fct_rides", ["ride_id"]).select(F.col("ride_id").alias("_ride"))


def _key_if(there: str) -> Column:
    return F.when(F.col(there).isNotNull(), X.surrogate_key(F.col(there)))


@fact
def fct_payments(s: Session, wanted: Collection[str] | None = None) -> DataFrame:
    """Payments with the keys of their rides, riders and methods; lookups whose keys aren't wanted are left out."""
    paid = s.ref("stg_payment_transaction").filter(~F.col("is_deleted")).withColumn("payment_date", X.local_date(F.col("created_at")))
    paid = s.recent("fct_payments", paid, X.local_date(F.col("updated_at")))
    # payments are dealt by their rides, those without one by their own ids
    by, at = F.coalesce("ride_id", "payment_transaction_id"), F.col("created_at")
    first = ("payment_transaction_id", "ride_sk", "rider_sk", "payment_method_sk", "ride_id", "rider_id", "payment_method_id")
    rest = [c for c in paid.columns if c not in (*first, "deleted_at", "is_deleted") and (wanted is None or c in wanted)]
    packed = paid.select("payment_transaction_id", "ride_id", "rider_id", "payment_method_id", "created_at", *([F.struct(*rest).alias("_rest")] if rest else []))
    packed = _with_keys(s, packed, by, [(x, f"{x}_id", at, None) for x in ("rider", "payment_method") if wanted is None or f"{x}_sk" in wanted])
    out = packed.join(_ride_ids(s), (F.col("_by") == F.col("_ride")) & F.col("ride_id").isNotNull(), "left").withColumn("ride_sk", _key_if("_ride"))
    held = [c for c in first if c in out.columns]
    return out.select(X.surrogate_key(F.col("payment_transaction_id")).alias("payment_transaction_sk"), *held, *[F.col(f"_rest.{c}").alias(c) for c in rest], s.now.alias(LOADED))


@fact
def fct_refunds(s: Session, wanted: Collection[str] | None = None) -> DataFrame:
    refunds = s.ref("stg_payment_refund").withColumn("refund_date", X.local_date(F.col("requested_at")))
    refunds = s.recent("fct_refunds", refunds, X.local_date(F.col("updated_at")))
    payments = s.part("fct_payments", ["payment_transaction_id"]).select(F.col("payment_transaction_id").alias("_payment"))
    out = refunds.join(payments, F.col("payment_transaction_id") == F.col("_payment"), "left").join(_ride_ids(s), F.col("ride_id") == F.col("_ride"), "left")
    columns = ["ride_id", "payment_transaction_id", *[c for c in refunds.columns if c not in ("ride_id", "payment_transaction_id")]]
    keys = [_key_if("_payment").alias("payment_transaction_sk"), _key_if("_ride").alias("ride_sk")]
    return out.select(X.surrogate_key(F.col("refund_id")).alias("refund_sk"), *columns, *keys, X.minutes_between(F.col("requested_at"), F.col("processed_at")).alias("refund_processing_min"), s.now.alias(LOADED))


@fact
def fct_support_tickets(s: Session, wanted: Collection[str] | None = None) -> DataFrame:
    tickets = s.ref("stg_support_ticket").filter(~F.col("is_deleted")).withColumn("opened_date", X.local_date(F.col("opened_at"))).drop("deleted_at", "is_deleted")
    tickets = s.recent("fct_support_tickets", tickets, X.local_date(F.col("updated_at")))
    found = _with_keys(s, tickets, F.col("ticket_id"), [(x, f"{x}_id", F.col("opened_at"), None) for x in ("rider", "driver")])
    out = found.join(_ride_ids(s), F.col("ride_id") == F.col("_ride"), "left")
    columns = ["ride_id", *[c for c in tickets.columns if c != "ride_id"], "rider_sk", "driver_sk"]
    return out.select(X.surrogate_key(F.col("ticket_id")).alias("ticket_sk"), *columns, _key_if("_ride").alias("ride_sk"), X.minutes_between(F.col("opened_at"), F.col("resolved_at")).alias("resolution_min"), s.now.alias(LOADED))


def _zero(c: str) -> Column:
    return F.sum(F.coalesce(F.col(c), F.lit(0)))


@model
def agg_daily_city_service(s: Session) -> DataFrame:
    rides = F.count_distinct("ride_id")
    return s.recent("agg_daily_city_service", s.part("fct_rides", "ride_id requested_date city_code service_type is_completed is_cancelled is_payment_failed total_fare platform_fee driver_earning accept_delay_min driver_arrival_min rating_score".split()), F.col("requested_date")).groupBy(F.col("requested_date").alias("metric_date"), "city_code", "service_type").agg(
        rides.alias("requested_rides"), *[X.flag_count(F.col(f"is_{k}")).alias(f"{k}_rides") for k in ("completed", "cancelled", "payment_failed")],
        X.safe_divide(X.flag_count(F.col("is_completed")), rides).alias("completion_rate"), X.safe_divide(X.flag_count(F.col("is_cancelled")), rides).alias("cancellation_rate"),
        _zero("total_fare").alias("gross_revenue"), _zero("platform_fee").alias("platform_revenue"), _zero("driver_earning").alias("driver_earnings"),
        F.avg("accept_delay_min").alias("avg_accept_delay_min"), F.avg("driver_arrival_min").alias("avg_driver_arrival_min"), F.avg("rating_score").alias("avg_rating"),
    ).withColumn(LOADED, s.now)


@model
def agg_daily_payment_method(s: Session) -> DataFrame:
    paid, failed = (F.col("payment_status") == v for v in ("PAID", "FAILED"))
    methods = s.ref("dim_payment_method").select("payment_method_sk", "method_code")
    return s.recent("agg_daily_payment_method", s.part("fct_payments", "payment_date payment_method_sk provider_name payment_status amount method_fee".split()), F.col("payment_date")).join(methods, "payment_method_sk", "left").groupBy(F.col("payment_date").alias("metric_date"), F.coalesce("method_code", F.lit("UNKNOWN")).alias("method_code"), "provider_name").agg(
        F.count(F.lit(1)).alias("payment_attempts"), X.flag_count(paid).alias("paid_payments"), X.flag_count(failed).alias("failed_payments"), X.safe_divide(X.flag_count(paid), F.count(F.lit(1))).alias("payment_success_rate"),
        F.sum("amount").alias("payment_amount"), F.sum("method_fee").alias("method_fee"),
    ).withColumn(LOADED, s.now)


@model
def agg_daily_refunds(s: Session) -> DataFrame:
    return s.recent("agg_daily_refunds", s.part("fct_refunds", "refund_date refund_status refund_reason_code refund_amount refund_processing_min".split()), F.col("refund_date")).groupBy(F.col("refund_date").alias("metric_date"), "refund_status", "refund_reason_code").agg(F.count(F.lit(1)).alias("refund_count"), F.sum("refund_amount").alias("refund_amount"), F.avg("refund_processing_min").alias("avg_refund_processing_min")).withColumn(LOADED, s.now)


@model
def agg_driver_performance_daily(s: Session) -> DataFrame:
    done = X.flag_count(F.col("is_completed"))
    return s.recent("agg_driver_performance_daily", s.part("fct_rides", "requested_date driver_sk city_code service_type is_completed driver_earning driver_arrival_min rating_score priority".split()), F.col("requested_date")).filter(F.col("driver_sk").isNotNull()).groupBy(F.col("requested_date").alias("metric_date"), "driver_sk", "city_code", "service_type").agg(
        F.count(F.lit(1)).alias("assigned_rides"), done.alias("completed_rides"), X.safe_divide(done, F.count(F.lit(1))).alias("driver_completion_rate"), _zero("driver_earning").alias("driver_earning"),
        F.avg("driver_arrival_min").alias("avg_arrival_min"), F.avg("rating_score").alias("avg_rating"), X.flag_count(F.col("priority") == "HIGH").alias("high_priority_tickets"),
    ).withColumn(LOADED, s.now)


@model
def agg_promo_performance_daily(s: Session) -> DataFrame:
    return s.recent("agg_promo_performance_daily", s.part("fct_rides", "requested_date promotion_sk city_code service_type is_completed promo_discount_amount total_fare rating_score".split()), F.col("requested_date")).filter(F.col("promotion_sk").isNotNull()).groupBy(F.col("requested_date").alias("metric_date"), "promotion_sk", "city_code", "service_type").agg(
        F.count(F.lit(1)).alias("promo_rides"), X.flag_count(F.col("is_completed")).alias("completed_promo_rides"), _zero("promo_discount_amount").alias("promo_discount_amount"), _zero("total_fare").alias("gross_revenue_after_discount"),
        X.safe_divide(_zero("total_fare"), _zero("promo_discount_amount")).alias("revenue_per_promo_discount"), F.avg("rating_score").alias("avg_rating"),
    ).withColumn(LOADED, s.now)


@model
def agg_ride_funnel_steps_daily(s: Session) -> DataFrame:
    group = ("metric_date", "city_code", "service_type")
    steps = {"requested": F.lit(True), **{k: F.col(f"{k}_at").isNotNull() for k in ("accepted", "arrived", "started")}, "completed": F.col("ride_status") == "COMPLETED", "paid": F.col("payment_status") == "PAID"}
    rides = s.recent("agg_ride_funnel_steps_daily", s.part("fct_rides", "ride_id requested_date city_code service_type accepted_at arrived_at started_at ride_status payment_status".split()), F.col("requested_date"))
    # one row a ride first, so that the distinct counts of all steps are plain sums
    once = rides.groupBy(F.col("requested_date").alias("metric_date"), "city_code", "service_type", "ride_id").agg(*[F.max(F.coalesce(c, F.lit(False))).alias(k) for k, c in steps.items()])
    counts = once.groupBy(*group).agg(*[X.flag_count(F.col(k)).alias(k) for k in steps])
    labels = ("01 Ride Requested", "02 Driver Accepted", "03 Driver Arrived", "04 Ride Started", "05 Ride Completed", "06 Payment Paid")
    return funnel_steps(counts, group, list(zip(("requested", "accepted", "arrived", "started", "completed", "paid"), labels, strict=True))).withColumn("transformed_at", s.now)

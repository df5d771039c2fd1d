"""A deterministic generator of the operational tables: every value is a hash of (seed, id, purpose), so the rows don't
depend on how they are partitioned, and any number of them is made by spark.range without a driver loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 42
#: Shares of cities and services, demand by hour, weekday (Monday first), month and day of month, fare rules in IDR.
CITIES = {"JKT": 0.62, "BDG": 0.20, "SBY": 0.18}
SERVICES = {"BIKE": 0.58, "CAR": 0.34, "XL": 0.08}
HOURS = (0.20, 0.12, 0.08, 0.06, 0.08, 0.20, 0.70, 1.45, 1.75, 1.35, 0.85, 0.90, 1.05, 0.85, 0.78, 0.82, 1.00, 1.65, 1.95, 1.70, 1.30, 0.95, 0.65, 0.38)
WEEKDAYS = (1.08, 1.00, 0.98, 1.02, 1.15, 1.22, 0.90)
GROWTH, PAYDAY, MONTH_START, MID_MONTH = 0.055, 1.10, 1.07, 0.94
BASE, PER_KM, PER_MINUTE, TAX, PLATFORM = 8000, 2500, 300, "0.11", "0.18"
OUTCOMES = {"COMPLETED": 84.0, "RIDER_CANCEL_BEFORE_ACCEPT": 4.0, "RIDER_CANCEL_AFTER_ACCEPT": 5.0, "DRIVER_CANCEL": 3.0, "PAYMENT_FAILED": 4.0}
LEAST_WEIGHT = 0.5
METHODS = (("EWALLET", 0.55), ("CARD", 0.75), ("BANK_TRANSFER", 0.88), ("CASH", 1.0))
FAILURES = ("INSUFFICIENT_BALANCE", "GATEWAY_TIMEOUT", "CARD_DECLINED", "EWALLET_PROVIDER_DOWN")
#: Campaigns with type, percentage or amount, cap and least fare.
CAMPAIGNS = (
    ("COMMUTEBIKE", "PERCENT", 10, 12000, 25000), ("WEEKENDCAR", "FIXED", 15000, 15000, 50000), ("PAYDAY25", "PERCENT", 15, 25000, 40000),
    ("JKTBOOST", "PERCENT", 8, 15000, 30000), ("RAINSAFE", "FIXED", 10000, 10000, 30000), ("SBYPAY", "PERCENT", 12, 18000, 35000),
)
START = "2026-01-01 00:00:00"


# The rules below are SQL texts over a day `d`, its weekday `w` (Monday is 0) and an hour `h`, for Spark and DuckDB alike.


def _real(x: float) -> str:
    return f"{x!r}e0"


def demand_expr(d: str, w: str | None = None) -> str:
    """The demand of a day: weekday, growth by months since the start, and days of the month that sell more or less."""
    weekly = "CASE " + (w or f"weekday({d})") + " " + " ".join(f"WHEN {k} THEN {_real(x)}" for k, x in enumerate(WEEKDAYS)) + " END"
    months = f"greatest(0, (year({d}) - {START[:4]}) * 12 + month({d}) - 1)"
    event = f"CASE WHEN day({d}) BETWEEN 25 AND 30 THEN {_real(PAYDAY)} WHEN day({d}) BETWEEN 1 AND 3 THEN {_real(MONTH_START)} WHEN day({d}) BETWEEN 13 AND 15 THEN {_real(MID_MONTH)} ELSE 1e0 END"
    return f"({weekly}) * (1e0 + {_real(GROWTH)} * {months}) * ({event})"


def hour_expr(d: str, h: str, w: str | None = None) -> str:
    """The weight of an hour: more on Friday evenings and Saturdays, less on Sunday mornings."""
    w = w or f"weekday({d})"
    base = f"CASE {h} " + " ".join(f"WHEN {k} THEN {_real(x)}" for k, x in enumerate(HOURS)) + " END"
    return f"({base}) * (CASE WHEN {w} = 4 AND {h} BETWEEN 17 AND 21 THEN 1.16e0 WHEN {w} = 5 AND {h} BETWEEN 10 AND 21 THEN 1.12e0 WHEN {w} = 6 AND {h} BETWEEN 8 AND 11 THEN 0.85e0 ELSE 1e0 END)"


def _peak(h: str) -> str:
    return f"({h} BETWEEN 7 AND 9 OR {h} BETWEEN 17 AND 20)"


def _shifted(base: dict[str, float], *shifts: tuple[str, dict[str, float]]) -> dict[str, str]:
    """The weights with what each condition adds to them."""
    return {k: " + ".join([_real(x), *(f"(CASE WHEN {when} THEN {_real(more[k])} ELSE 0e0 END)" for when, more in shifts if k in more)]) for k, x in base.items()}


def city_weights(d: str, h: str, w: str | None = None) -> dict[str, str]:
    """Peak hours belong to Jakarta, Saturdays a little to Bandung."""
    return _shifted(CITIES, (_peak(h), {"JKT": 0.10, "BDG": -0.04, "SBY": -0.06}), (f"{w or f'weekday({d})'} = 5", {"BDG": 0.04, "JKT": -0.02, "SBY": -0.02}))


def service_weights(d: str, h: str, city: str, w: str | None = None) -> dict[str, str]:
    """Bikes in the morning and in Jakarta's evening, cars on weekends."""
    return _shifted(
        SERVICES, (f"{h} BETWEEN 7 AND 9", {"BIKE": 0.12, "CAR": -0.08, "XL": -0.04}), (f"{w or f'weekday({d})'} >= 5", {"BIKE": -0.10, "CAR": 0.06, "XL": 0.04}),
        (f"({city} = 'JKT' AND {h} BETWEEN 17 AND 20)", {"BIKE": 0.06, "CAR": -0.02, "XL": -0.04}),
    )


def context_flags(d: str, h: str, city: str, rain_draw: str, shortage_draw: str, w: str | None = None) -> dict[str, str]:
    """What weighs on a ride: peak, weekend, rain, payment incident, promotion days, shortage of drivers. Draws are in [0, 1)."""
    w = w or f"weekday({d})"
    rain = f"({city} = 'JKT' AND {h} BETWEEN 16 AND 18 AND {rain_draw} < (CASE WHEN month({d}) <= 3 THEN 0.34e0 ELSE 0.22e0 END))"
    return {
        "is_peak": _peak(h), "is_weekend": f"({w} >= 5)", "rain": rain,
        "payment_incident": f"({city} = 'SBY' AND {h} BETWEEN 19 AND 20 AND (day({d}) IN (6, 17, 28) OR ({w} = 4 AND day({d}) % 2 = 0)))",
        "promo_boost": f"(day({d}) % 10 IN (1, 2, 3) OR day({d}) BETWEEN 25 AND 28)",
        "supply_shortage": f"({_peak(h)} AND {city} = 'JKT' AND {shortage_draw} < (CASE WHEN {rain} THEN 0.28e0 ELSE 0.16e0 END))",
    }


def outcome_weights(slow_accept: str, slow_arrival: str, surge: str, peak: str = "is_peak", rain: str = "rain", shortage: str = "supply_shortage", incident: str = "payment_incident") -> dict[str, str]:
    """Weights of a ride's outcomes in its context; none falls under LEAST_WEIGHT."""
    before, after, driver = "RIDER_CANCEL_BEFORE_ACCEPT", "RIDER_CANCEL_AFTER_ACCEPT", "DRIVER_CANCEL"
    weights = _shifted(
        OUTCOMES, (peak, {"COMPLETED": -3.0, after: 1.8, driver: 1.2}), (rain, {"COMPLETED": -7.0, after: 3.5, driver: 3.5}), (shortage, {"COMPLETED": -6.0, before: 2.0, driver: 4.0}),
        (incident, {"PAYMENT_FAILED": 9.0, "COMPLETED": -9.0}), (slow_accept, {before: 2.5, "COMPLETED": -2.5}), (slow_arrival, {after: 2.5, "COMPLETED": -2.5}), (surge, {before: 1.0, after: 1.2, "COMPLETED": -2.2}),
    )
    return {k: f"greatest({_real(LEAST_WEIGHT)}, {x})" for k, x in weights.items()}


def campaign_weights(d: str, h: str, city: str, service: str, weekend: str, rain: str, w: str | None = None) -> dict[str, str]:
    """Weights of the named campaigns where they fit; 1 where they don't."""
    w = w or f"weekday({d})"
    fits = {"COMMUTEBIKE": (f"{service} = 'BIKE' AND {w} < 5 AND {h} BETWEEN 7 AND 9", 8), "WEEKENDCAR": (f"{weekend} AND {service} IN ('CAR', 'XL')", 8), "PAYDAY25": (f"day({d}) BETWEEN 25 AND 30", 7), "JKTBOOST": (f"{city} = 'JKT'", 5), "RAINSAFE": (rain, 6), "SBYPAY": (f"{city} = 'SBY'", 5)}
    return {k: f"(CASE WHEN {when} THEN {_real(float(x))} ELSE 1e0 END)" for k, (when, x) in fits.items()}


def promo_chance(d: str, h: str, city: str, service: str, weekend: str, boost: str, w: str | None = None) -> str:
    """The chance that a ride uses a promotion, at most 0.45."""
    more = ((boost, 0.17), (f"({weekend} AND {service} IN ('CAR', 'XL'))", 0.10), (f"({service} = 'BIKE' AND {w or f'weekday({d})'} < 5 AND {h} BETWEEN 7 AND 9)", 0.08), (f"{city} = 'JKT'", 0.03))
    return "least(0.45e0, 0.13e0" + "".join(f" + (CASE WHEN {when} THEN {_real(x)} ELSE 0e0 END)" for when, x in more) + ")"


def drawn(weights: dict[str, str], draw: str) -> str:
    """The name whose part of the summed weights holds a draw from [0, 1)."""
    whole, names = " + ".join(f"({x})" for x in weights.values()), list(weights)
    cuts = [" + ".join(f"({weights[n]})" for n in names[: k + 1]) for k in range(len(names) - 1)]
    return "case " + " ".join(f"when {draw} * ({whole}) < {cut} then '{name}'" for name, cut in zip(names, cuts)) + f" else '{names[-1]}' end"


def chance(purpose: str, *ids: str) -> str:
    """SQL for a number in [0, 1) that depends on the seed, the purpose and the ids only."""
    return f"(pmod(xxhash64({SEED}, '{purpose}', {', '.join(ids)}), 1000003) / 1000003.0D)"


def pick(options: tuple[tuple[str, float], ...], draw: str) -> str:
    return "case " + " ".join(f"when {draw} < {upto} then '{name}'" for name, upto in options[:-1]) + f" else '{options[-1][0]}' end"


def _upto(shares: dict[str, float]) -> tuple[tuple[str, float], ...]:
    """Names with running sums of their shares."""
    out, total = [], 0.0
    for name, share in shares.items():
        total += share
        out.append((name, round(total, 9)))
    return tuple(out)


def fare_columns(km: Column, minutes: Column, surge: Column, discount: Column | None = None) -> dict[str, Column]:
    """The parts of a fare, half-up to hundredths; the discount never makes the total negative."""
    cents = lambda x: F.round(x.cast("decimal(30,6)"), 2)
    base, distance, time = F.lit(BASE).cast("decimal(18,2)"), cents(km * PER_KM), cents(minutes * PER_MINUTE)
    ride = base + distance + time
    extra = cents(ride * (surge - F.lit(1).cast("decimal(6,2)")))
    gross = ride + extra
    off = F.least(F.lit(0).cast("decimal(18,2)") if discount is None else F.coalesce(discount, F.lit(0).cast("decimal(18,2)")), gross)
    tax = cents((gross - off) * F.lit(TAX).cast("decimal(4,2)"))
    fee = cents(gross * F.lit(PLATFORM).cast("decimal(4,2)"))
    return {"base_fare": base, "distance_fare": distance, "time_fare": time, "surge_amount": extra, "discount_amount": off, "tax_amount": tax, "platform_fee": fee, "driver_earning": gross - fee, "total_fare": gross - off + tax}


def _first_over(cuts: str, u: str, n: int) -> str:
    """How many of n sorted cuts aren't over u, by halving."""
    halves = ", ".join(str(1 << k) for k in reversed(range(n.bit_length())))
    return f"aggregate(array({halves}), 0, (at, step) -> if(at + step <= {n} and element_at({cuts}, least({n}, at + step)) <= {u}, at + step, at))"


def _settled(df: DataFrame) -> DataFrame:
    """The same rows, whose columns no later expression repeats: an explode of one row stands between."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_r")).select("_r.*")


def _versions(df: DataFrame, key: str, share: float) -> DataFrame:
    """Each row as created, and for a share of the keys a changed version some weeks later."""
    later = f"{chance('change', key)} < {share}"
    rows = df.withColumn("_v", F.explode(F.expr(f"if({later}, array(0, 1), array(0))")))
    moved = F.expr(f"created_at + make_dt_interval(_v * (20 + cast({chance('when', key)} * 60 as int)))")
    return rows.withColumn("updated_at", moved)


def tables(spark: SparkSession, rides: int, riders: int | None = None, drivers: int | None = None, days: int = 170) -> dict[str, DataFrame]:
    """The 17 tables by name. Entities hold all their versions (a history); events and transactions hold one."""
    riders, drivers, promos = riders or max(20, rides // 7), drivers or max(10, rides // 34), 24
    stamp = lambda offset: f"timestamp_ntz'{START}' + {offset}"
    out: dict[str, DataFrame] = {}

    born = stamp(f"make_dt_interval(-90 + cast({chance('born', 'id')} * 120 as int))")
    people = spark.range(1, riders + 1)
    out["rider_account"] = _versions(people.selectExpr("id AS rider_id", "concat('rider_', id) AS username", "concat('Rider ', id) AS full_name", "concat('r', id, '@example.com') AS email", "concat('+62', 800000000 + id) AS phone_number",
        pick(_upto(CITIES), chance("rcity", "id")) + " AS city_code", f"{born} AS created_at", "cast(null as timestamp_ntz) AS deleted_at"), "rider_id", 0.1).selectExpr("* except(_v)", "if(_v = 1, 'SUSPENDED', 'ACTIVE') AS account_status")
    fleet = spark.range(1, drivers + 1)
    out["driver_profile"] = _versions(fleet.selectExpr("id AS driver_id", "concat('Driver ', id) AS driver_name", "concat('+62', 900000000 + id) AS phone_number", pick(_upto(CITIES), chance("dcity", "id")) + " AS city_code", "'VERIFIED' AS verification_status",
        f"cast(4 + {chance('rate', 'id')} as decimal(4,2)) AS rating_avg", f"cast({chance('rates', 'id')} * 500 as bigint) AS rating_count", f"{born} AS created_at", "cast(null as timestamp_ntz) AS deleted_at"), "driver_id", 0.3).selectExpr("* except(_v)", "if(_v = 1, 'BUSY', 'AVAILABLE') AS driver_status")
    kind = pick(_upto(SERVICES), chance("service", "id"))
    out["vehicle"] = _versions(fleet.selectExpr("id AS vehicle_id", "id AS driver_id", "concat('B', id, 'XY') AS license_plate", f"{kind} AS vehicle_type", "'Honda' AS vehicle_make", "concat('M', id % 9) AS vehicle_model", "2015 + id % 11 AS vehicle_year",
        f"{born} AS created_at", "cast(null as timestamp_ntz) AS deleted_at"), "vehicle_id", 0.1).selectExpr("* except(_v)", "if(_v = 1, 'MAINTENANCE', 'ACTIVE') AS vehicle_status")
    out["driver_vehicle_assignment"] = _versions(fleet.selectExpr("id AS assignment_id", "id AS driver_id", "id AS vehicle_id", f"{born} AS assigned_from", "cast(null as timestamp_ntz) AS assigned_to", f"{born} AS created_at"), "assignment_id", 0.05).selectExpr("* except(_v)", "_v = 0 AS is_active")
    out["driver_shift"] = fleet.selectExpr("id AS shift_id", "id AS driver_id", "'CLOSED' AS shift_status", f"{born} AS started_at", f"{born} + interval 9 hours AS ended_at", f"{born} AS created_at", f"{born} + interval 9 hours AS updated_at")
    out["payment_method"] = _versions(people.selectExpr("id AS payment_method_id", "id AS rider_id", pick(METHODS, chance("method", "id")) + " AS method_code", "concat('Provider', id % 5) AS provider_name", "concat('****', id % 10000) AS masked_account",
        "true AS is_default", f"{born} AS created_at", "cast(null as timestamp_ntz) AS deleted_at"), "payment_method_id", 0.08).selectExpr("* except(_v)", "if(_v = 1, 'EXPIRED', 'ACTIVE') AS payment_method_status")
    campaigns = " union all ".join(f"select {k} as id, '{c}' as code, '{t}' as kind, {x} as x, {cap} as cap, {least} as least" for k, (c, t, x, cap, least) in enumerate(CAMPAIGNS, 1))
    others = f"select id + {len(CAMPAIGNS)} as id, concat('PROMO', id) as code, if(id % 2 = 0, 'PERCENT', 'FIXED') as kind, if(id % 2 = 0, 5 + id % 4 * 5, 5000 + id % 4 * 5000) as x, 12000 + id % 4 * 6000 as cap, 20000 + id % 4 * 10000 as least from range(1, {promos - len(CAMPAIGNS) + 1})"
    out["promotion"] = _versions(spark.sql(f"{campaigns} union all {others}").selectExpr("cast(id as bigint) AS promotion_id", "code AS promo_code", "concat('Campaign ', code) AS promo_description", "kind AS discount_type", "if(kind = 'PERCENT', cast(x as decimal(6,2)), null) AS discount_pct",
        "if(kind = 'FIXED', cast(x as decimal(18,2)), null) AS discount_amount", "cast(cap as decimal(18,2)) AS max_discount_amount", "cast(least as decimal(18,2)) AS min_fare_amount", stamp("interval -60 days") + " AS valid_from", stamp("interval 200 days") + " AS valid_to",
        stamp("interval -60 days") + " AS created_at", "cast(null as timestamp_ntz) AS deleted_at"), "promotion_id", 0.1).selectExpr("* except(_v)", "if(_v = 1, 'PAUSED', 'ACTIVE') AS promotion_status")

    # each day's and hour's part of the demand, with a noise of 8 and 15 hundredths either way, as running sums
    calendar = f"select d, h, ({demand_expr('d')}) * ({hour_expr('d', 'h')}) * (0.92 + 0.16 * {chance('noise', 'cast(unix_date(d) as bigint)')}) * (0.85 + 0.30 * {chance('hnoise', 'cast(unix_date(d) as bigint)', 'h')}) as part from (select explode(sequence(date'{START[:10]}', date_add(date'{START[:10]}', {days - 1}))) as d) lateral view explode(sequence(0, 23)) as h"
    slots = spark.sql(calendar).orderBy("d", "h").collect()  # one row an hour of the calendar
    whole, sums = sum(r["part"] for r in slots), []
    for r in slots:
        sums.append((sums[-1] if sums else 0.0) + r["part"] / whole)
    cuts = spark.createDataFrame([(sums,)], "cuts array<double>")
    placed = spark.range(1, rides + 1).join(F.broadcast(cuts)).selectExpr("id", f"{chance('day', 'id')} AS u", "cuts").selectExpr("id", f"least({len(sums) - 1}, {_first_over('cuts', 'u', len(sums))}) AS slot")
    timed = placed.selectExpr("id", "slot % 24 AS h", f"date_add(date'{START[:10]}', cast(slot div 24 as int)) AS d")
    placed = _settled(timed).selectExpr("*", f"{drawn(city_weights('d', 'h'), chance('city', 'id'))} AS city_code")
    placed = _settled(placed).selectExpr("*", f"{drawn(service_weights('d', 'h', 'city_code'), chance('kind', 'id'))} AS service_type", *[f"{x} AS {k}" for k, x in context_flags("d", "h", "city_code", chance("rain", "id"), chance("short", "id")).items()])
    # the hour is Jakarta's; stored times are UTC
    asked = _settled(placed).selectExpr("id AS ride_id", f"cast(d as timestamp_ntz) + make_dt_interval(0, cast(h as int) - 7, 0, {chance('sec', 'id')} * 3599) AS requested_at", "h", "d", f"1 + cast({chance('rider', 'id')} * {riders} as bigint) AS rider_id", f"1 + cast({chance('driver', 'id')} * {drivers} as bigint) AS driver_id",
        "city_code", "service_type", "is_peak", "is_weekend", "rain", "payment_incident", "promo_boost", "supply_shortage", f"cast(1 + 18 * {chance('km', 'id')} as decimal(10,2)) AS km", f"cast(5 + 50 * {chance('min', 'id')} as decimal(10,2)) AS minutes",
        f"1 + cast({chance('acc', 'id')} * 6 as int) + if(supply_shortage, 3, 0) AS accept_min", f"2 + cast({chance('arr', 'id')} * 12 as int) + if(rain, 4, 0) AS arrive_min", "cast(1 + if(is_peak, 0.3, 0) + if(rain, 0.2, 0) + if(supply_shortage, 0.2, 0) as decimal(6,2)) AS surge")
    asked = _settled(asked).selectExpr("*", f"{drawn(outcome_weights('accept_min > 6.5', 'arrive_min > 16', 'surge >= 1.5'), chance('outcome', 'ride_id'))} AS outcome")
    asked = _settled(asked).selectExpr("*", "case when outcome like '%CANCEL%' then 'CANCELLED' when outcome = 'COMPLETED' and ride_id % 97 = 0 then 'IN_PROGRESS' else outcome end AS ride_status")
    went = _settled(asked).selectExpr("*", "ride_status in ('COMPLETED', 'PAYMENT_FAILED') AS done", "outcome <> 'RIDER_CANCEL_BEFORE_ACCEPT' AS taken").selectExpr("*",
        "if(taken, requested_at + make_dt_interval(0, 0, accept_min), null) AS accepted_at").selectExpr("*",
        "if(taken and ride_status <> 'CANCELLED', accepted_at + make_dt_interval(0, 0, arrive_min), null) AS arrived_at").selectExpr("*", "arrived_at + interval 2 minutes AS started_at").selectExpr("*", "if(done, started_at + make_dt_interval(0, 0, cast(minutes as int)), null) AS completed_at",
        "if(ride_status = 'CANCELLED', coalesce(accepted_at, requested_at) + interval 3 minutes, null) AS cancelled_at")
    ride = _settled(went).selectExpr("*", "greatest(requested_at, coalesce(completed_at, cancelled_at, started_at, accepted_at, requested_at)) AS updated_at")
    out["ride"] = ride.selectExpr("ride_id", "rider_id", "if(taken, driver_id, null) AS driver_id", "if(taken, driver_id, null) AS vehicle_id", "ride_status", "service_type", "city_code", "requested_at", "accepted_at", "arrived_at", "started_at", "completed_at", "cancelled_at",
        "if(cancelled_at is null, null, if(outcome = 'DRIVER_CANCEL', 'DRIVER', 'RIDER')) AS cancelled_by_type", "if(cancelled_at is null, null, 'CHANGED_MIND') AS cancel_reason_code", "km AS estimated_distance_km", "minutes AS estimated_duration_min", "requested_at AS created_at", "updated_at", "cast(null as timestamp_ntz) AS deleted_at")
    stages = (("REQUESTED", "requested_at"), ("ACCEPTED", "accepted_at"), ("ARRIVED", "arrived_at"), ("IN_PROGRESS", "started_at"), ("COMPLETED", "completed_at"), ("CANCELLED", "cancelled_at"))
    steps = "filter(array(" + ", ".join(f"struct({k} AS k, {'null' if k == 0 else repr(stages[k - 1 if k < 5 else 1][0])} AS old, '{s}' AS new, {c} AS changed_at)" for k, (s, c) in enumerate(stages)) + "), x -> x.changed_at is not null)"
    out["ride_status_history"] = ride.selectExpr("ride_id", f"explode({steps}) AS x").selectExpr("ride_id * 10 + x.k AS ride_status_history_id", "ride_id", "x.old AS old_status", "x.new AS new_status", "'SYSTEM' AS changed_by_type", "cast(null as bigint) AS changed_by_id",
        "cast(null as string) AS reason_code", "cast(null as string) AS reason_note", "x.changed_at", "x.changed_at AS created_at")
    spot = lambda p: f"cast(-6.2 + {chance(p + 'lat', 'ride_id')} / 10 as decimal(10,6)) AS latitude, cast(106.8 + {chance(p + 'lon', 'ride_id')} / 10 as decimal(10,6)) AS longitude"
    places = [(0, "PICKUP_REQUESTED", "requested_at"), (1, "DROPOFF_REQUESTED", "requested_at"), (2, "PICKUP_ACTUAL", "started_at"), (3, "DROPOFF_ACTUAL", "completed_at")]
    seen = "filter(array(" + ", ".join(f"struct({k} AS k, '{t}' AS t, {c} AS at)" for k, t, c in places) + "), x -> x.at is not null)"
    out["ride_location"] = ride.selectExpr("ride_id", f"explode({seen}) AS x").selectExpr("ride_id * 4 + x.k AS ride_location_id", "ride_id", "x.t AS location_type", *spot("loc").replace(" AS latitude, ", " AS latitude|").split("|"), "cast(null as string) AS address_text", "x.at AS captured_at", "x.at AS created_at")
    out["ride_tracking_point"] = ride.filter("started_at is not null").selectExpr("ride_id", "driver_id", "started_at", "explode(sequence(0, 4)) AS k").selectExpr("ride_id * 5 + k AS tracking_point_id", "ride_id", "driver_id", *spot("trk").replace(" AS latitude, ", " AS latitude|").split("|"),
        f"cast(15 + 40 * {chance('speed', 'ride_id', 'k')} as decimal(10,2)) AS speed_kmh", "started_at + make_dt_interval(0, 0, k * 2) AS recorded_at", "started_at AS created_at")

    weights = campaign_weights("d", "h", "city_code", "service_type", "is_weekend", "rain") | {"OTHER": _real(float(promos - len(CAMPAIGNS)))}
    ids = "case campaign " + " ".join(f"when '{c[0]}' then {k}" for k, c in enumerate(CAMPAIGNS, 1)) + f" else {len(CAMPAIGNS) + 1} + cast({chance('promo', 'ride_id')} * {promos - len(CAMPAIGNS)} as bigint) end"
    uses = f"{chance('uses', 'ride_id')} < {promo_chance('d', 'h', 'city_code', 'service_type', 'is_weekend', 'promo_boost')}"
    priced = ride.filter("done").selectExpr("*", f"{drawn(weights, chance('campaign', 'ride_id'))} AS campaign")
    priced = _settled(priced).selectExpr("* except(campaign)", f"if({uses}, {ids}, null) AS promotion_id")
    ride_price = f"({BASE} + km * {PER_KM} + minutes * {PER_MINUTE})"
    offer = out["promotion"].filter("promotion_status = 'ACTIVE'").selectExpr("promotion_id", "discount_type", "discount_pct", "discount_amount", "max_discount_amount", "min_fare_amount")
    priced = priced.join(F.broadcast(offer), "promotion_id", "left")
    off = f"cast(case when discount_type is null or {ride_price} < min_fare_amount then 0 when discount_type = 'PERCENT' then least(max_discount_amount, {ride_price} * discount_pct / 100) else least(discount_amount, max_discount_amount) end as decimal(18,2))"
    fares = priced.withColumn("off", F.expr(off))
    fares = fares.withColumns(fare_columns(F.col("km"), F.col("minutes"), F.col("surge"), F.col("off")))
    out["ride_fare"] = fares.selectExpr("ride_id AS fare_id", "ride_id", "'FINAL' AS fare_type", "1L AS fare_version", "'IDR' AS currency_code", "km AS distance_km", "minutes AS duration_min", "base_fare", "distance_fare", "time_fare", "surge AS surge_multiplier", "surge_amount", "discount_amount", "tax_amount",
        "platform_fee", "driver_earning", "total_fare", "'STANDARD' AS fare_rule_code", "false AS is_corrected", "completed_at AS calculated_at", "completed_at AS created_at", "completed_at AS updated_at")
    failed = "ride_status = 'PAYMENT_FAILED'"
    out["payment_transaction"] = fares.selectExpr("ride_id AS payment_transaction_id", "ride_id", "rider_id", "rider_id AS payment_method_id", "concat('Provider', rider_id % 5) AS provider_name", "concat('tx', ride_id) AS provider_transaction_id", "md5(cast(ride_id as string)) AS idempotency_key", "total_fare AS amount",
        "cast(total_fare * 0.01 as decimal(18,2)) AS method_fee", "'IDR' AS currency_code", f"if({failed}, 'FAILED', 'PAID') AS payment_status", f"if({failed}, element_at(array({', '.join(repr(x) for x in FAILURES)}), cast(ride_id % {len(FAILURES)} as int) + 1), null) AS failure_code",
        f"if({failed}, 'payment was not made', null) AS failure_message", "completed_at AS authorized_at", f"if({failed}, null, completed_at) AS captured_at", f"if({failed}, null, completed_at + interval 1 minute) AS paid_at", "completed_at AS created_at", "completed_at + interval 1 minute AS updated_at", "cast(null as timestamp_ntz) AS deleted_at")
    out["promo_usage"] = fares.filter("promotion_id is not null and off > 0").selectExpr("ride_id AS promo_usage_id", "promotion_id", "ride_id", "rider_id", "off AS discount_amount_applied", "completed_at AS used_at", "completed_at AS created_at", "completed_at AS updated_at")
    out["review"] = fares.filter(f"{chance('review', 'ride_id')} < 0.45").selectExpr("ride_id AS review_id", "ride_id", "'RIDER' AS reviewer_type", "rider_id AS reviewer_id", "'DRIVER' AS reviewee_type", "driver_id AS reviewee_id", f"cast(3 + {chance('stars', 'ride_id')} * 3 as bigint) AS rating_score",
        "cast(null as string) AS comments", "'PUBLISHED' AS review_status", "completed_at + interval 1 hour AS created_at", "completed_at + interval 1 hour AS updated_at", "cast(null as timestamp_ntz) AS deleted_at")
    out["support_ticket"] = ride.filter(f"{chance('ticket', 'ride_id')} < 0.03").selectExpr("ride_id AS ticket_id", "if(ride_id % 11 = 0, null, ride_id) AS ride_id", "rider_id", "driver_id", "'SERVICE' AS ticket_category", "if(ride_id % 4 = 0, 'OPEN', 'RESOLVED') AS ticket_status", "if(ride_id % 5 = 0, 'HIGH', 'MEDIUM') AS priority",
        "updated_at + interval 2 hours AS opened_at", "if(ride_id % 4 = 0, null, updated_at + interval 30 hours) AS resolved_at", "updated_at + interval 2 hours AS created_at", "updated_at + interval 30 hours AS updated_at", "cast(null as timestamp_ntz) AS deleted_at")
    out["payment_refund"] = fares.filter(f"not ({failed}) and {chance('refund', 'ride_id')} < 0.02").selectExpr("ride_id AS refund_id", "ride_id AS payment_transaction_id", "ride_id", "cast(total_fare / 2 as decimal(18,2)) AS refund_amount", "'SERVICE_QUALITY' AS refund_reason_code", "'PROCESSED' AS refund_status",
        "completed_at + interval 1 day AS requested_at", "completed_at + interval 50 hours AS processed_at", "completed_at + interval 1 day AS created_at", "completed_at + interval 50 hours AS updated_at")
    return out


def live(ticks: DataFrame, rides_per_minute: int = 10, riders: int = 5_000, drivers: int = 1_500) -> DataFrame:
    """Rides of a simulated clock from numbered ticks (`value`), one ride each: every `rides_per_minute` of them are a minute.

    A ride goes through its whole life at once: its times, status and city follow from its number, as in `tables`.
    """
    asked = ticks.selectExpr("value + 1 AS ride_id", f"timestamp_ntz'{START}' + INTERVAL '1' MINUTE * (value div {rides_per_minute}) AS requested_at")
    placed = _settled(asked.selectExpr("*", "to_date(requested_at) AS d", "hour(requested_at) AS h").selectExpr("*", f"{drawn(city_weights('d', 'h'), chance('city', 'ride_id'))} AS city_code"))
    rated = _settled(placed.selectExpr("*", f"{drawn(service_weights('d', 'h', 'city_code'), chance('kind', 'ride_id'))} AS service_type", *[f"{x} AS {k}" for k, x in context_flags("d", "h", "city_code", chance("rain", "ride_id"), chance("short", "ride_id")).items()]))
    return rated.selectExpr("ride_id", "requested_at", f"1 + cast({chance('rider', 'ride_id')} * {riders} as bigint) AS rider_id", f"1 + cast({chance('driver', 'ride_id')} * {drivers} as bigint) AS driver_id", "city_code", "service_type", f"{drawn(outcome_weights('false', 'false', 'false'), chance('outcome', 'ride_id'))} AS outcome")


def live_rides(spark: SparkSession, rides_per_second: int = 200, rides_per_minute: int = 10) -> DataFrame:
    """An endless stream of such rides: a simulated minute takes rides_per_minute / rides_per_second seconds."""
    return live(spark.readStream.format("rate").option("rowsPerSecond", rides_per_second).load().select("value"), rides_per_minute)


def reserved_ids(spark: SparkSession, store, name: str, column: str, n: int) -> DataFrame:
    """The next n ids of a table of a store."""
    first = store.next_id(name, column)
    return spark.range(first, first + n).withColumnRenamed("id", column)

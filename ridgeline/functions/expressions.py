"""Column expressions shared by the plans: all are built-in functions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what stands for a null part of a surrogate key.
NULL_PART = "_dbt_utils_surrogate_key_null_"
#: The zone of the business.
ZONE = "Asia/Jakarta"
OPEN_END = "9999-12-31 00:00:00"


def safe_divide(a: Column, b: Column) -> Column:
    """a / b as double, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def minutes_between(start: Column, end: Column) -> Column:
    """Whole minutes from start to end, truncated toward zero."""
    return F.timestamp_diff("MINUTE", start, end).cast("bigint")


def to_zone(ts: Column, zone: str) -> Column:
    """The wall clock of a zone at a naive UTC time, as a naive time; the session's zone doesn't matter."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def local(ts: Column, zone: str = ZONE) -> Column:
    """Naive wall clock of the business's zone, or another, of a naive UTC timestamp."""
    return to_zone(ts, zone)


def format_local(ts: Column, pattern: str, zone: str = ZONE) -> Column:
    return F.date_format(local(ts, zone), pattern)


def local_date(ts: Column, zone: str = ZONE) -> Column:
    return F.to_date(local(ts, zone))


def local_hour(ts: Column, zone: str = ZONE) -> Column:
    return F.hour(local(ts, zone)).cast("bigint")


def today(zone: str = ZONE, now: Column | None = None) -> Column:
    """The date in a zone, now or at the naive UTC time that is given in its place."""
    return local_date(F.expr("cast(current_timestamp() as timestamp_ntz)") if now is None else now, zone)


def is_weekend(ts: Column, zone: str = ZONE) -> Column:
    return F.dayofweek(local_date(ts, zone)).isin(1, 7)


def is_peak(ts: Column, zone: str = ZONE) -> Column:
    hour = local_hour(ts, zone)
    return hour.between(7, 9) | hour.between(17, 20)


def to_utc(ts: Column, zone: str | None) -> Column:
    """A naive time of `zone` as naive UTC; unchanged where zone is None (the source was aware of its zone)."""
    return ts if zone is None else F.convert_timezone(F.lit(zone), F.lit("UTC"), ts)


def clamp(x: Column, low: Column, high: Column) -> Column:
    """x, but not under low nor over high."""
    return F.greatest(low, F.least(x, high))


def surrogate_key(*parts: Column) -> Column:
    """md5 of the parts as text, joined by '-', a null part being told from an empty one."""
    return F.md5(F.concat_ws("-", *[F.coalesce(p.cast("string"), F.lit(NULL_PART)) for p in parts]))


def exact_sum(x: Column, digits: int = 2) -> Column:
    """A sum of doubles that doesn't depend on their order."""
    return F.sum(x.cast(f"decimal(18,{digits})")).cast("double")


def money(x: Column) -> Column:
    """Half-up to hundredths."""
    return F.round(x.cast("decimal(38,9)"), 2)


def flag_count(condition: Column) -> Column:
    return F.count_if(condition).cast("bigint")


def within(ts: Column, valid_from: Column, valid_to: Column) -> Column:
    """ts in the half-open [valid_from, valid_to), an open end being far in the future."""
    return (ts >= valid_from) & (ts < F.coalesce(valid_to, F.to_timestamp_ntz(F.lit(OPEN_END))))

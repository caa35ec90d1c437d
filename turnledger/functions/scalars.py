"""Time and rounding expressions. All of them stay in JVM code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
HOUR_MS = 3_600_000
NANO = 1_000_000_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cell(ts_ms: Column | str, width_ms: int) -> Column:
    """Index of the fixed-width time cell that holds ``ts_ms``."""
    return F.floor(col(ts_ms) / F.lit(width_ms)).cast("long")


def utc_day(ts_ms: Column | str) -> Column:
    """UTC calendar day by integer arithmetic, so the session time zone does not matter."""
    return F.date_from_unix_date(cell(ts_ms, DAY_MS).cast("int"))


def day_text(day: Column | str) -> Column:
    return col(day).cast("string")


def local_hour(ts_ms: Column | str, tz: str) -> Column:
    if tz == "UTC":
        return F.pmod(cell(ts_ms, HOUR_MS), F.lit(24)).cast("int")
    return F.hour(F.from_utc_timestamp(F.timestamp_millis(col(ts_ms)), tz))


def local_weekday(ts_ms: Column | str, tz: str) -> Column:
    """0 = Monday."""
    if tz == "UTC":
        return F.pmod(cell(ts_ms, DAY_MS) + F.lit(3), F.lit(7)).cast("int")
    return F.weekday(F.from_utc_timestamp(F.timestamp_millis(col(ts_ms)), tz))


def parse_ts_ms(text: Column) -> Column:
    """ISO-8601 text or an epoch-millisecond number (as text) to epoch ms; NULL when neither."""
    number = F.when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), text.cast("double").cast("long"))
    stamp = F.try_to_timestamp(F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), text))
    return F.coalesce(number, F.unix_millis(stamp))


def iso_utc(ts_ms: Column | str) -> Column:
    """Epoch ms to ISO-8601 text in UTC (session time zone UTC)."""
    return F.date_format(F.timestamp_millis(col(ts_ms)), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")


def half_even(x: Column, places: int) -> Column:
    """Round half to even on doubles: scale, rint, unscale."""
    scale = float(10 ** places)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def usd(nano: Column | str, places: int = 4) -> Column:
    """Exact nano-USD to USD, rounded once, half to even."""
    step = float(10 ** (9 - places))
    return F.rint(col(nano) / F.lit(step)) / F.lit(float(10 ** places))


def safe_ratio(num: Column, den: Column, default: float | None = 0.0) -> Column:
    out = F.when(den != 0, num / den)
    return out if default is None else out.otherwise(F.lit(default))

"""Time arithmetic. Hour buckets are ``timestamp_ntz``; none of this depends on the session time zone."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted text layouts of a trip start time besides ISO.
TRIP_TIME_LAYOUTS = ("M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy h:mm:ss a", "M/d/yyyy h:mm a")
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def col(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def ntz(value: datetime | str) -> Column:
    """Literal wall-clock time."""
    return F.lit(str(value)).cast("timestamp_ntz")


def hour_index(ts: str | Column) -> Column:
    """Whole hours since 1970-01-01 of a wall-clock time (bigint)."""
    ts = col(ts)
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    return day * 24 + F.hour(ts)


def hour_from_index(index: str | Column) -> Column:
    return F.timestamp_add("HOUR", col(index).cast("int"), F.expr(EPOCH))


def floor_hour(ts: str | Column) -> Column:
    ts = col(ts)
    return F.timestamp_add("HOUR", F.hour(ts), F.to_date(ts).cast("timestamp_ntz"))


def micros(ts: str | Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), col(ts))


def minutes_between(earlier: str | Column, later: str | Column) -> Column:
    return F.timestamp_diff("MICROSECOND", col(earlier), col(later)) / F.lit(60_000_000.0)


def age_hours(ts: str | Column, now: str | Column, digits: int = 2) -> Column:
    return F.round(minutes_between(ts, now) / 60.0, digits)


def hours_before(ts: Column, hours: float) -> Column:
    return F.timestamp_add("SECOND", F.lit(-int(hours * 3600)), ts)


def utc_wall(df: DataFrame, name: str) -> Column:
    """UTC wall-clock view of an instant column; ``timestamp_ntz`` columns are taken to be UTC already."""
    if df.schema[name].dataType.typeName() == "timestamp":
        return F.convert_timezone(None, F.lit("UTC"), F.col(name).cast("timestamp_ntz"))
    return F.col(name).cast("timestamp_ntz")


def local_hour(utc: Column, timezone: str) -> Column:
    """UTC wall clock to the local hour bucket. The repeated autumn hour merges into one bucket."""
    return floor_hour(F.convert_timezone(F.lit("UTC"), F.lit(timezone), utc))


def utc_offset_hours(local: Column, timezone: str) -> Column:
    """UTC offset in force at a local wall-clock time: of two repeated readings that of the earlier, in the hour that a
    spring change skips that after the change (the reading is shifted forward)."""
    as_utc = F.convert_timezone(F.lit(timezone), F.lit("UTC"), local)
    shown = F.convert_timezone(F.lit("UTC"), F.lit(timezone), as_utc)
    return F.timestamp_diff("SECOND", as_utc, shown) / F.lit(3600.0)


def parse_trip_time(text: Column) -> Column:
    """First layout that fits, else NULL. ISO times with an offset keep their wall clock."""
    iso = F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", "").try_cast("timestamp_ntz")
    # A bare number or a year is not a time, though a lenient cast would accept "2026".
    iso = F.when(text.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}"), iso)
    others = [F.try_to_timestamp(text, F.lit(p)).cast("timestamp_ntz") for p in TRIP_TIME_LAYOUTS]
    return F.coalesce(iso, *others)

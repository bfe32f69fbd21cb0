"""Time expressions over naive (TIMESTAMP_NTZ) columns.

Parts are taken by integer arithmetic on microseconds: it needs no time zone, and it
costs a fraction of the calendar functions on the hot paths. The one cast to
TIMESTAMP is free of zone effects because the session zone is UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICROS = {
    "microsecond": 1,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
}
_EPOCH_WEEKDAY = 3  # 1970-01-01 was a Thursday (Monday = 0)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def floor_micros(unit: str, ts: Column) -> Column:
    """Start of the unit in microseconds: a cheap grouping key."""
    us = micros(ts)
    return us - F.pmod(us, F.lit(MICROS[unit]))


def _index(unit: str, ts: Column) -> Column:
    # an exact quotient: both sides are multiples of the unit
    return (floor_micros(unit, ts) / F.lit(MICROS[unit])).cast("long")


def hour_floor(ts: Column) -> Column:
    return from_micros(floor_micros("hour", ts))


def seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def minutes_between(start: Column, end: Column) -> Column:
    """Whole-second boundaries crossed, in minutes."""
    return (seconds(end) - seconds(start)) / F.lit(60.0)


def exact_minutes_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(60_000_000.0)


def add_minutes(ts: Column, minutes: Column) -> Column:
    return from_micros(micros(ts) + F.round(minutes * 60_000_000.0).cast("long"))


def weekday(ts: Column) -> Column:
    """Monday = 0 .. Sunday = 6."""
    return F.pmod(_index("day", ts) + _EPOCH_WEEKDAY, F.lit(7)).cast("long")


def hour_of_day(ts: Column) -> Column:
    return F.pmod(_index("hour", ts), F.lit(24)).cast("long")


def hour_of_week(ts: Column) -> Column:
    """weekday * 24 + hour: Monday 00:00 is 0."""
    return F.pmod(_index("hour", ts) + _EPOCH_WEEKDAY * 24, F.lit(168)).cast("long")


def month_key(ts: Column) -> Column:
    """``YYYY-MM``"""
    return F.substring(F.to_date(ts).cast("string"), 1, 7)

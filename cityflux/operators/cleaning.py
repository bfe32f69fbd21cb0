"""Raw trip rows -> canonical, filtered, duplicate-free trips."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import MAX_DURATION_MIN, MAX_TRIP_MILES, ZONE_MAX, ZONE_MIN
from ..functions import clock
from ..functions.numbers import as_long

RAW_COLUMNS = (
    "tpep_pickup_datetime",
    "tpep_dropoff_datetime",
    "PULocationID",
    "DOLocationID",
    "trip_distance",
    "passenger_count",
)
TRIP_COLUMNS = (
    "pickup_ts",
    "dropoff_ts",
    "pu_location_id",
    "do_location_id",
    "trip_distance",
    "passenger_count",
    "duration_min",
)


@dataclass(frozen=True)
class CleaningRules:
    """Lower limits are exclusive, upper limits inclusive; zones inclusive."""

    max_duration_min: float = MAX_DURATION_MIN
    max_distance: float = MAX_TRIP_MILES
    zone_min: int = ZONE_MIN
    zone_max: int = ZONE_MAX


def project_raw(raw: DataFrame) -> DataFrame:
    """The six raw columns under canonical names and types."""
    return raw.select(
        F.col("tpep_pickup_datetime").cast("timestamp_ntz").alias("pickup_ts"),
        F.col("tpep_dropoff_datetime").cast("timestamp_ntz").alias("dropoff_ts"),
        as_long(raw, "PULocationID").alias("pu_location_id"),
        as_long(raw, "DOLocationID").alias("do_location_id"),
        F.col("trip_distance").cast("double").alias("trip_distance"),
        as_long(raw, "passenger_count").alias("passenger_count"),
    )


def _bound(value) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp_ntz")


def _raw_prefilter(raw: DataFrame, start: Column, end: Column, rules: CleaningRules) -> DataFrame:
    """Necessary conditions on untouched columns, which the scan can evaluate."""
    pickup = F.col("tpep_pickup_datetime")
    if dict(raw.dtypes)["tpep_pickup_datetime"] == "timestamp_ntz":
        raw = raw.where((pickup >= start) & (pickup < end))
    distance = F.col("trip_distance")
    raw = raw.where((distance > 0) & (distance <= rules.max_distance))
    for zone in ("PULocationID", "DOLocationID"):
        # half a zone wider: fractional ids are rounded later
        raw = raw.where(F.col(zone).between(rules.zone_min - 0.5, rules.zone_max + 0.5))
    return raw


def filter_trips(raw: DataFrame, start, end, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """Projection plus every row rule, before duplicates are removed."""
    start, end = _bound(start), _bound(end)
    trips = project_raw(_raw_prefilter(raw, start, end, rules))
    duration = clock.minutes_between(F.col("pickup_ts"), F.col("dropoff_ts"))
    return trips.where(
        (F.col("pickup_ts") >= start)
        & (F.col("pickup_ts") < end)
        & (duration > 0)
        & (duration <= rules.max_duration_min)
        & F.col("pu_location_id").between(rules.zone_min, rules.zone_max)
        & F.col("do_location_id").between(rules.zone_min, rules.zone_max)
    )


def dedupe_trips(trips: DataFrame) -> DataFrame:
    """Exact duplicates collapse to one row, nulls being equal; then the duration.

    The duration follows from the other columns, so it stays out of the shuffle.
    """
    return trips.distinct().withColumn(
        "duration_min", clock.minutes_between(F.col("pickup_ts"), F.col("dropoff_ts"))
    )


def clean_trips(raw: DataFrame, start, end, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """Trips with ``start <= pickup < end`` that pass every rule."""
    return dedupe_trips(filter_trips(raw, start, end, rules)).select(*TRIP_COLUMNS)


def clean_months(
    raw: DataFrame, months: Sequence[str], rules: CleaningRules = CleaningRules()
) -> DataFrame:
    """Raw rows of many months, each cleaned against the month of its file, in one job.

    ``raw`` carries the file's month as ``month``; a row filed under another month is
    dropped. Months are disjoint after that, so one ``distinct`` over all of them
    equals one per month.
    """
    if not months:
        raise ValueError("no months to clean")
    start, _ = month_bounds(min(months))
    _, end = month_bounds(max(months))
    wanted = raw.where(F.col("month").isin(*months))
    filed = clock.month_key(F.col("tpep_pickup_datetime").cast("timestamp_ntz"))
    trips = dedupe_trips(filter_trips(wanted.where(filed == F.col("month")), start, end, rules))
    return trips.select(*TRIP_COLUMNS, clock.month_key(F.col("pickup_ts")).alias("month"))


def month_bounds(month: str) -> tuple[Column, Column]:
    first = F.to_date(F.lit(f"{month}-01"))
    return first.cast("timestamp_ntz"), F.add_months(first, 1).cast("timestamp_ntz")


def union_trips(*parts: DataFrame) -> DataFrame:
    """Cleaned parts of disjoint periods as one table; nothing is compared again."""
    return reduce(DataFrame.unionByName, parts)

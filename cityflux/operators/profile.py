"""Weekly demand profile: mean pickups per hour for each zone and hour of week."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..constants import HOURS_PER_WEEK, ZONE_MAX, ZONE_MIN
from ..functions import clock
from ..functions.numbers import ratio
from .panel import hourly_counts, shared_counts, time_bounds

PROFILE_COLUMNS = ("zone_id", "how", "rate_per_hour")


def week_slots(spark: SparkSession, zone_min: int = ZONE_MIN, zone_max: int = ZONE_MAX) -> DataFrame:
    """Every (zone, hour of week)."""
    n = (zone_max - zone_min + 1) * HOURS_PER_WEEK
    return spark.range(n).select(
        (F.floor(F.col("id") / HOURS_PER_WEEK) + zone_min).alias("zone_id"),
        (F.col("id") % HOURS_PER_WEEK).alias("how"),
    )


def _occurrences(how: Column, lo: Column, hi: Column) -> Column:
    """How often an hour of week occurs among the hours ``lo`` .. ``hi``."""
    hours = F.floor((clock.seconds(hi) - clock.seconds(lo)) / 3600).cast("long") + 1
    offset = F.pmod(how - clock.hour_of_week(lo), F.lit(HOURS_PER_WEEK))
    return F.floor((hours - 1 - offset) / HOURS_PER_WEEK).cast("long") + 1


def demand_profile(
    trips: DataFrame, zone_min: int = ZONE_MIN, zone_max: int = ZONE_MAX
) -> DataFrame:
    """Mean over all observed hours, empty ones included; 0.0 where nothing was seen.

    Sums of the sparse counts over the number of such hours: no dense panel.
    """
    counts = hourly_counts(trips)
    # never null, like the other keys: see shared_counts
    how = F.coalesce(clock.hour_of_week(F.col("ts")), F.lit(0).cast("long")).alias("how")
    sums = shared_counts(counts).groupBy("zone_id", how).agg(
        F.sum("pickups").alias("_sum")
    )
    slots = week_slots(trips.sparkSession, zone_min, zone_max)
    return (
        slots.join(sums, ["zone_id", "how"], "left")
        .withColumn("_b", time_bounds(counts))
        .select(
            "zone_id",
            "how",
            ratio(
                F.coalesce("_sum", F.lit(0)),
                F.greatest(_occurrences(F.col("how"), F.col("_b.lo"), F.col("_b.hi")), F.lit(0)),
            ).alias("rate_per_hour"),
        )
    )


def weekly_totals(profile: DataFrame) -> DataFrame:
    return profile.groupBy("zone_id").agg(F.sum("rate_per_hour").alias("weekly_pickups"))


def active_zones(profile: DataFrame) -> DataFrame:
    """Zones with any expected demand."""
    return weekly_totals(profile).where(F.col("weekly_pickups") > 0)


def zone_weights(profile: DataFrame) -> DataFrame:
    """Share of weekly demand per zone; equal shares when there is no demand at all.

    The total runs over the zones of one profile: 263 rows.
    """
    every = Window.partitionBy()
    total, n = F.sum("weekly_pickups").over(every), F.count(F.lit(1)).over(every)
    return weekly_totals(profile).select(
        "zone_id",
        F.when(total > 0, F.col("weekly_pickups") / total).otherwise(1.0 / n).alias("weight"),
    )


def _checked_profile(profile: DataFrame) -> DataFrame:
    """At most 263 x 168 rows reach the broadcast, whatever the table holds."""
    return (
        profile.where(
            F.col("zone_id").between(ZONE_MIN, ZONE_MAX)
            & F.col("how").between(0, HOURS_PER_WEEK - 1)
        )
        .groupBy("zone_id", "how")
        .agg(F.max("rate_per_hour").alias("rate_per_hour"))
    )


def arrival_rate(df: DataFrame, profile: DataFrame, zone: str, ts: str) -> DataFrame:
    """Add ``rate_per_min``: expected riders per minute, 0.0 for unknown keys."""
    rates = _checked_profile(profile).withColumnsRenamed({"zone_id": "_zone", "how": "_how"})
    return (
        df.join(
            F.broadcast(rates),
            (F.col(zone) == F.col("_zone")) & (clock.hour_of_week(F.col(ts)) == F.col("_how")),
            "left",
        )
        .withColumn("rate_per_min", F.coalesce("rate_per_hour", F.lit(0.0)) / 60.0)
        .drop("_zone", "_how", "rate_per_hour")
    )


def hour_slices(zones: DataFrame, start: Column, end: Column) -> DataFrame:
    """``[start, end)`` of each zone cut at full hours: slice_start, minutes."""
    first = clock.hour_floor(start)
    hours = F.when(
        start < end,
        F.sequence(
            first,
            clock.hour_floor(clock.from_micros(clock.micros(end) - 1)),
            F.expr("INTERVAL 1 HOUR"),
        ),
    )
    return (
        zones.withColumn("_hour", F.explode(hours))
        .withColumn("slice_start", F.greatest(F.col("_hour"), start))
        .withColumn(
            "minutes",
            clock.exact_minutes_between(
                F.col("slice_start"),
                F.least(F.col("_hour") + F.expr("INTERVAL 1 HOUR"), end),
            ),
        )
        .drop("_hour")
    )


def expected_arrivals(profile: DataFrame, zones: DataFrame, start: Column, end: Column) -> DataFrame:
    """Expected riders per zone and hour slice of ``[start, end)``."""
    slices = hour_slices(zones.select("zone_id"), start, end)
    return arrival_rate(slices, profile, "zone_id", "slice_start").select(
        "zone_id",
        "slice_start",
        "minutes",
        (F.col("rate_per_min") * F.col("minutes")).alias("expected"),
    )

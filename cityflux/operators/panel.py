"""Hourly demand panel: every zone x every observed hour, with its past."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..constants import LAG_HOURS, ROLL_HOURS, ZONE_MAX, ZONE_MIN
from ..functions import clock
from ..functions.holidays import is_federal_holiday

PANEL_KEYS = ("zone_id", "ts")
FEATURE_COLUMNS = (
    "zone_id", "ts", "pickups", "hour", "dow", "is_holiday", *LAG_HOURS, *ROLL_HOURS,
)


def hourly_counts(trips: DataFrame, zone: str = "pu_location_id", ts: str = "pickup_ts") -> DataFrame:
    """Pickups per (zone, hour); combined map-side, so a hot zone ships its hours only."""
    hour = clock.floor_micros("hour", F.col(ts))
    counts = trips.groupBy(F.col(zone).alias("zone_id"), hour.alias("_hour")).agg(
        F.count(F.lit(1)).alias("pickups")
    )
    return counts.select("zone_id", clock.from_micros(F.col("_hour")).alias("ts"), "pickups")


def time_bounds(counts: DataFrame, ts: str = "ts") -> Column:
    """First and last observed hour as one struct subquery (``lo``, ``hi``, ``n``).

    Rows outside the zone domain count here too. The total keeps this aggregate equal
    to the one of the main plan, which then reuses its shuffle.
    """
    return counts.agg(
        F.struct(
            F.min(ts).alias("lo"), F.max(ts).alias("hi"), F.sum("pickups").alias("n")
        ).alias("b")
    ).scalar()


def shared_counts(counts: DataFrame) -> DataFrame:
    """Counts with keys that are never null, for a join beside :func:`time_bounds`.

    On nullable keys the join would filter nulls below the aggregate, the two
    aggregates would differ, and the trips would be scanned and shuffled twice.
    Zone 0 is outside the domain, as null is.
    """
    return counts.withColumns(
        {
            "zone_id": F.coalesce("zone_id", F.lit(0).cast("long")),
            "ts": F.coalesce("ts", clock.from_micros(F.lit(0).cast("long"))),
        }
    )


def zones_table(spark: SparkSession, zone_min: int = ZONE_MIN, zone_max: int = ZONE_MAX) -> DataFrame:
    """One row per zone id, spread by a hash of the zone."""
    return spark.range(zone_min, zone_max + 1).select(F.col("id").alias("zone_id"))


def _hours(bounds: Column) -> Column:
    return F.sequence(
        bounds.getField("lo"), bounds.getField("hi"), F.expr("INTERVAL 1 HOUR")
    )


def dense_grid(counts: DataFrame, zone_min: int = ZONE_MIN, zone_max: int = ZONE_MAX) -> DataFrame:
    """(zone_id, ts, pickups) with zeros filled in; unknown zones fall away.

    The hours are generated per zone, so the zones carry the parallelism.
    """
    grid = (
        zones_table(counts.sparkSession, zone_min, zone_max)
        .withColumn("_b", time_bounds(counts))
        .select("zone_id", F.explode(_hours(F.col("_b"))).alias("ts"))
    )
    return grid.join(shared_counts(counts), list(PANEL_KEYS), "left").select(
        *PANEL_KEYS, F.coalesce("pickups", F.lit(0).cast("long")).alias("pickups")
    )


def add_calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    col = F.col(ts)
    return df.withColumns(
        {
            "hour": clock.hour_of_day(col),
            "dow": clock.weekday(col),
            "is_holiday": is_federal_holiday(ts),
        }
    )


def add_lags(
    panel: DataFrame, lags: Mapping[str, int] = LAG_HOURS, key: str = "zone_id",
    ts: str = "ts", value: str = "pickups",
) -> DataFrame:
    """Value ``k`` rows earlier; the panel is dense, so rows are hours."""
    order = Window.partitionBy(key).orderBy(ts)
    return panel.withColumns(
        {name: F.lag(value, k).over(order).cast("double") for name, k in lags.items()}
    )


def add_rolling_means(
    panel: DataFrame, rolls: Mapping[str, int] = ROLL_HOURS, key: str = "zone_id",
    ts: str = "ts", value: str = "pickups",
) -> DataFrame:
    """Mean of the ``w`` rows strictly before, fewer at the start, null on the first.

    Differences of one running (integer) total: constant work per row for any ``w``.
    """
    order = Window.partitionBy(key).orderBy(ts)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = panel.withColumns(
        {"_cum": F.sum(value).over(so_far), "_row": F.row_number().over(order)}
    )
    zero = F.lit(0).cast("long")
    means = {
        name: F.when(
            F.col("_row") > 1,
            (F.lag("_cum", 1).over(order) - F.coalesce(F.lag("_cum", w + 1).over(order), zero))
            / F.least(F.lit(w), F.col("_row") - 1),
        )
        for name, w in rolls.items()
    }
    return out.withColumns(means).drop("_cum", "_row")


def demand_features(
    trips: DataFrame, zone_min: int = ZONE_MIN, zone_max: int = ZONE_MAX
) -> DataFrame:
    """Counts, dense panel, calendar and strictly-past history; one window sort."""
    panel = dense_grid(hourly_counts(trips), zone_min, zone_max)
    return add_calendar(add_rolling_means(add_lags(panel))).select(*FEATURE_COLUMNS)


# ---- month by month ------------------------------------------------------------

#: hours of its past that a row of features depends on
HISTORY = max(*LAG_HOURS.values(), *ROLL_HOURS.values())


def carry_over(panel: DataFrame, hours: int = HISTORY) -> DataFrame:
    """The panel's last hours per zone: all that the features of later hours depend on.

    A panel that is shorter is kept whole, so rows count from its first hour as in a full build.
    """
    newest = panel.agg(F.max("ts").alias("t")).scalar()
    recent = F.col("ts") > newest - F.expr(f"INTERVAL {int(hours)} HOURS")
    return panel.where(recent).select(*PANEL_KEYS, "pickups")


def later_panel(
    trips: DataFrame, carry: DataFrame, zone_min: int = ZONE_MIN, zone_max: int = ZONE_MAX
) -> DataFrame:
    """(zone_id, ts, pickups) of the hours after ``carry`` up to the last trip, gaps filled.

    Trips at or before the carried hours are refused: months are added in order.
    """
    counts = hourly_counts(trips)
    last = carry.agg(F.max("ts")).first()[0]
    if last is None:
        return dense_grid(counts, zone_min, zone_max)
    newest = F.lit(last).cast("timestamp_ntz")
    hour = F.expr("INTERVAL 1 HOUR")
    early = F.raise_error(F.lit(f"trips at or before {last}, which the panel already holds"))
    first = F.when(F.col("_b.lo") <= newest, early.cast("timestamp_ntz")).otherwise(newest + hour)
    grid = (
        zones_table(trips.sparkSession, zone_min, zone_max)
        .withColumn("_b", time_bounds(counts))
        .where(F.col("_b.hi").isNotNull())
        .select("zone_id", F.explode(F.sequence(first, F.col("_b.hi"), hour)).alias("ts"))
    )
    return grid.join(shared_counts(counts), list(PANEL_KEYS), "left").select(
        *PANEL_KEYS, F.coalesce("pickups", F.lit(0).cast("long")).alias("pickups")
    )


def later_features(
    trips: DataFrame, carry: DataFrame, zone_min: int = ZONE_MIN, zone_max: int = ZONE_MAX
) -> DataFrame:
    """Features of the hours after ``carry``, equal to those of a full build.

    Only the new trips and the carried hours are read.
    """
    new = later_panel(trips, carry, zone_min, zone_max).withColumn("_new", F.lit(True))
    both = carry.select(*PANEL_KEYS, "pickups").withColumn("_new", F.lit(False)).unionByName(new)
    past = add_rolling_means(add_lags(both)).where("_new")
    return add_calendar(past).select(*FEATURE_COLUMNS)

"""The given tables seen as raw trips, a ride event log, zones and dispatch ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..constants import (
    CANCELLED,
    COMPLETED,
    MATCHED,
    PATIENCE_MIN,
    PICKED_UP,
    REQUESTED,
    ZONE_MAX,
)
from ..functions import clock
from ..operators.events import as_event_log
from ..operators.ordered import next_value

MONTH = "2024-01"
START, END = "2024-01-01", "2024-02-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _trips_once(events: DataFrame) -> DataFrame:
    """One trip per event: it ends when the same user's next event happens."""
    slim = events.select("event_id", "ts", "user_id", "value", "props")
    return next_value(slim, ["user_id"], ["ts", "event_id"], F.col("ts"), "next_ts", "hour")


def raw_trips(events: DataFrame) -> DataFrame:
    """Raw trip files of one month; every 50th row is there twice."""
    k = F.get_json_object("props", "$.k").cast("long") % 7
    once = _trips_once(events).select(
        "event_id",
        F.col("ts").alias("tpep_pickup_datetime"),
        F.col("next_ts").alias("tpep_dropoff_datetime"),
        F.when(k != 0, k).cast("double").alias("passenger_count"),
        F.col("value").alias("trip_distance"),
        (F.col("user_id") % 263 + 1).alias("PULocationID"),
        (F.col("event_id") % 265 + 1).alias("DOLocationID"),
    )
    copies = F.when(F.col("event_id") % 50 == 0, 2).otherwise(1)
    return once.select(
        *[c for c in once.columns if c != "event_id"],
        F.explode(F.array_repeat(F.lit(1), copies)).alias("_copy"),
    ).drop("_copy")


def shipping_trips(lineitem: DataFrame) -> DataFrame:
    """Raw trips over many months, with the month of the file they came in.

    Every 97th order is filed under a wrong month.
    """
    pickup = clock.add_minutes(
        F.col("l_shipdate").cast("timestamp_ntz"), (F.col("l_orderkey") % 1440).cast("double")
    )
    filed = F.when(F.col("l_orderkey") % 97 == 0, "1995-01").otherwise(
        clock.month_key(F.col("l_shipdate"))
    )
    pax = F.col("l_linenumber") % 7
    return lineitem.select(
        pickup.alias("tpep_pickup_datetime"),
        clock.add_minutes(pickup, (F.col("l_partkey") % 200).cast("double")).alias(
            "tpep_dropoff_datetime"
        ),
        F.when(pax != 0, pax).cast("double").alias("passenger_count"),
        (F.col("l_quantity") * 2.5).alias("trip_distance"),
        (F.col("l_suppkey") % 265 + 1).alias("PULocationID"),
        (F.col("l_partkey") % 265 + 1).alias("DOLocationID"),
        filed.alias("month"),
    )


def ride_events(events: DataFrame) -> DataFrame:
    """An event log: rider = event, driver = user, a few rules broken on purpose.

    Trips of more than 180 minutes become cancelled requests, trips without an end
    stay open, every 101st rider also cancels after its match, and every 103rd
    completes before its pickup.
    """
    e = F.col("event_id")
    wait = (e % 97) / 10.0
    trips = _trips_once(events).select(
        e.alias("rider_id"),
        F.col("user_id").alias("driver_id"),
        (F.col("user_id") % ZONE_MAX + 1).alias("origin"),
        (e % ZONE_MAX + 1).alias("dest"),
        F.col("ts").alias("pickup"),
        F.col("next_ts").alias("done"),
        wait.alias("wait"),
        clock.add_minutes(F.col("ts"), -(wait + (e % 5))).alias("request"),
        clock.add_minutes(F.col("ts"), (-(e % 5)).cast("double")).alias("match"),
    )
    none_long, none_double = F.lit(None).cast("long"), F.lit(None).cast("double")

    def event(order, kind, ts, driver=none_long, zone=none_long, wait_min=none_double):
        return F.struct(
            (F.col("rider_id") * 8 + order).alias("seq"),
            F.lit(kind).alias("kind"),
            ts.alias("ts"),
            driver.alias("driver_id"),
            zone.alias("zone_id"),
            wait_min.alias("wait_min"),
        )

    driver = F.col("driver_id")
    request = event(0, REQUESTED, F.col("request"), zone=F.col("origin"))
    match = event(1, MATCHED, F.col("match"), driver, wait_min=F.col("wait"))
    gone = event(
        2,
        CANCELLED,
        clock.add_minutes(F.col("request"), F.lit(PATIENCE_MIN)),
        zone=F.col("origin"),
        wait_min=F.lit(PATIENCE_MIN),
    )
    late_gone = event(
        2, CANCELLED, F.col("match"), zone=F.col("origin"), wait_min=F.col("wait")
    )
    pickup = event(3, PICKED_UP, F.col("pickup"), driver)
    late_pickup = event(3, PICKED_UP, clock.add_minutes(F.col("done"), F.lit(1.0)), driver)
    done = event(4, COMPLETED, F.col("done"), driver, F.col("dest"))
    minutes = clock.minutes_between(F.col("pickup"), F.col("done"))
    rider = F.col("rider_id")
    steps = (
        F.when(F.col("done").isNull(), F.array(request, match, pickup))
        .when(minutes > 180, F.array(request, gone))
        .when(rider % 101 == 0, F.array(request, match, late_gone, pickup, done))
        .when(rider % 103 == 0, F.array(request, match, late_pickup, done))
        .otherwise(F.array(request, match, pickup, done))
    )
    rows = trips.select("rider_id", F.explode(steps).alias("s")).select("rider_id", "s.*")
    return as_event_log(rows)


def centroids(events: DataFrame) -> DataFrame:
    """Zone centroids as the mean of the event positions in each zone.

    The positions are made up (the real geometry is not available).
    """
    e = F.col("event_id")
    z = e % ZONE_MAX + 1
    return events.groupBy(z.alias("zone_id")).agg(
        F.avg(F.lit(40.5) + (z * 7919) % 1000 / 2500.0 + (e % 13) / 10000.0).alias("lat"),
        F.avg(F.lit(-74.2) + (z * 104729) % 1000 / 2000.0 + (e % 11) / 10000.0).alias("lon"),
    )


def tick_riders(events: DataFrame) -> DataFrame:
    """Views and clicks wait for a ride in the hour they happen."""
    return events.where(F.col("event_type").isin("view", "click")).select(
        clock.hour_floor(F.col("ts")).alias("tick"),
        F.col("event_id").alias("rider_id"),
        (F.col("user_id") % ZONE_MAX + 1).alias("zone"),
        F.col("ts").alias("request_ts"),
        F.col("event_id").alias("rider_pos"),
    )


def tick_drivers(events: DataFrame) -> DataFrame:
    """The other events are drivers idle in that hour."""
    return events.where(~F.col("event_type").isin("view", "click")).select(
        clock.hour_floor(F.col("ts")).alias("tick"),
        F.col("event_id").alias("driver_id"),
        (F.col("event_id") * 7 % ZONE_MAX + 1).alias("zone"),
        F.col("event_id").alias("driver_pos"),
    )


def named_zones(part: DataFrame) -> DataFrame:
    """Part names as zone names: every zone has many rows, and names repeat."""
    return part.select(
        (F.col("p_partkey") % ZONE_MAX + 1).alias("zone_id"),
        F.col("p_name").alias("zone"),
        F.col("p_brand").alias("borough"),
    )

"""Zone names, distances and travel times."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..constants import SPEED_KMH, ZONE_MAX, ZONE_MIN
from ..functions import clock
from ..functions.numbers import haversine_km


def known_zones(zones: DataFrame) -> DataFrame:
    """One row per id inside the zone domain: at most 263 rows, safe to broadcast.

    Of rows that repeat an id the least by its other columns counts.
    """
    rest = [c for c in zones.columns if c != "zone_id"]
    known = zones.where(F.col("zone_id").between(ZONE_MIN, ZONE_MAX)).groupBy("zone_id")
    least = known.agg(F.min(F.struct(*rest)).alias("_rest")) if rest else known.agg(F.lit(0))
    return least.select("zone_id", *[F.col(f"_rest.`{c}`") for c in rest])


def known_distances(distances: DataFrame) -> DataFrame:
    """One row per pair inside the zone domain, the shortest: at most 263 x 263 rows."""
    inside = F.col("zone_a").between(ZONE_MIN, ZONE_MAX) & F.col("zone_b").between(ZONE_MIN, ZONE_MAX)
    return distances.where(inside).groupBy("zone_a", "zone_b").agg(F.min("km").alias("km"))


def name_zones(df: DataFrame, zones: DataFrame, zone: str) -> DataFrame:
    """Add ``zone_name`` and ``borough``; null where the id is unknown."""
    names = known_zones(zones).select(
        F.col("zone_id").alias("_zone"), F.col("zone").alias("zone_name"), "borough"
    )
    return df.join(F.broadcast(names), F.col(zone) == F.col("_zone"), "left").drop("_zone")


def unknown_zones(df: DataFrame, zones: DataFrame, zone: str) -> DataFrame:
    """Rows whose zone id has no entry; must be empty."""
    ids = known_zones(zones).select(F.col("zone_id").alias("_zone"))
    return df.join(F.broadcast(ids), F.col(zone) == F.col("_zone"), "left_anti")


def ids_by_name(zones: DataFrame) -> DataFrame:
    """Name -> id; the largest id where a name is used twice."""
    return known_zones(zones).groupBy("zone").agg(F.max("zone_id").alias("zone_id"))


def zone_distances(centroids: DataFrame) -> DataFrame:
    """(zone_a, zone_b, km) for every ordered pair of known zones, 263 x 263 at most.

    Each centroid meets the list of all centroids, which is one bounded array.
    """
    points = known_zones(centroids).select("zone_id", "lat", "lon")
    others = points.agg(
        F.sort_array(F.collect_list(F.struct("zone_id", "lat", "lon"))).alias("all")
    ).scalar()
    pairs = points.withColumn("_all", others).select(
        F.col("zone_id").alias("zone_a"), "lat", "lon", F.explode("_all").alias("b")
    )
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("b.lat"), F.col("b.lon"))
    return pairs.select("zone_a", F.col("b.zone_id").alias("zone_b"), km.alias("km"))


def add_travel_time(
    df: DataFrame, distances: DataFrame, origin: str, dest: str, speed_kmh: float = SPEED_KMH,
    km: str = "km", minutes: str = "travel_min",
) -> DataFrame:
    """Straight-line distance and time; null where a zone is unknown.

    The distances of known zones are at most 263 x 263 rows, so they are broadcast.
    """
    if speed_kmh <= 0:
        raise ValueError("speed_kmh must be positive")
    table = known_distances(distances).select(
        F.col("zone_a").alias("_a"), F.col("zone_b").alias("_b"), F.col("km").alias(km)
    )
    joined = df.join(
        F.broadcast(table), (F.col(origin) == F.col("_a")) & (F.col(dest) == F.col("_b")), "left"
    )
    return joined.withColumn(minutes, F.col(km) / F.lit(float(speed_kmh)) * 60.0).drop("_a", "_b")


def leg_times(
    rides: DataFrame, distances: DataFrame, speed_kmh: float = SPEED_KMH
) -> DataFrame:
    """Matched rides (driver_zone, origin, dest, match_ts) -> times of both legs.

    The driver ends in the destination zone.
    """
    out = add_travel_time(
        rides, distances, "driver_zone", "origin", speed_kmh, "pickup_km", "to_pickup_min"
    )
    out = add_travel_time(out, distances, "origin", "dest", speed_kmh, "trip_km", "trip_min")
    return (
        out.withColumn("pickup_ts", clock.add_minutes(F.col("match_ts"), F.col("to_pickup_min")))
        .withColumn("done_ts", clock.add_minutes(F.col("pickup_ts"), F.col("trip_min")))
        .withColumn("next_driver_zone", F.col("dest"))
    )

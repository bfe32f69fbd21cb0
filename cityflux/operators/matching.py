"""Riders and drivers of one dispatch tick: reachability, nearest, FIFO matching.

Distances depend on zones only, so all drivers of a zone are equally far from a
rider. Supply is therefore reduced to one row per (tick, zone) before any join and
rider x driver pairs never exist. FIFO matching runs in rounds of proposals (see
``dispatch``); policies can be registered. Inputs:

riders   tick, rider_id, zone, request_ts, rider_pos (input order)
drivers  tick, driver_id, zone, driver_pos (input order; a driver once per tick)
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..constants import RADIUS_KM, ZONE_MAX
from .dispatch import match_in_rounds
from .geo import known_distances
from .skew import join_spread

# Tasks get the matching functions by value: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ASSIGNMENT_DDL = "tick timestamp_ntz, rider_id bigint, driver_id bigint, pickup_km double"


def _reach(distances: DataFrame, radius_km: float) -> DataFrame:
    """Zone pairs within the (inclusive) radius: 263 x 263 rows at most."""
    return known_distances(distances).where(F.col("km") <= float(radius_km))


def _supply_near(drivers: DataFrame, distances: DataFrame, radius_km: float) -> DataFrame:
    """Per (tick, rider zone): reachable drivers and the best one."""
    per_zone = drivers.groupBy("tick", "zone").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.struct("driver_pos", "driver_id")).alias("_top"),
    )
    # distance is driver zone -> rider zone; the pair table is bounded, see _reach
    near = per_zone.join(
        F.broadcast(_reach(distances, radius_km)), F.col("zone") == F.col("zone_a")
    )
    best = F.min_by(
        F.struct(F.col("_top.driver_id").alias("driver_id"), F.col("km")),
        F.struct(F.col("km"), (-F.col("_top.driver_pos")).alias("late")),
    )
    return near.groupBy("tick", F.col("zone_b").alias("zone")).agg(
        F.sum("_n").alias("reachable_drivers"), best.alias("_best")
    )


def drivers_in_radius(
    riders: DataFrame, drivers: DataFrame, distances: DataFrame, radius_km: float = RADIUS_KM
) -> DataFrame:
    """Per rider: how many drivers of the tick are in reach, and the closest distance."""
    near = _supply_near(drivers, distances, radius_km)
    return join_spread(riders, near, ["tick", "zone"], "rider_id", "left").select(
        "tick",
        "rider_id",
        F.coalesce("reachable_drivers", F.lit(0).cast("long")).alias("reachable_drivers"),
        F.col("_best.km").alias("nearest_km"),
    )


def nearest_driver(
    riders: DataFrame, drivers: DataFrame, distances: DataFrame, radius_km: float = RADIUS_KM
) -> DataFrame:
    """Closest driver per rider, each rider seen alone; ties go to the last in order."""
    near = _supply_near(drivers, distances, radius_km)
    return join_spread(riders, near, ["tick", "zone"], "rider_id").select(
        "tick",
        "rider_id",
        F.col("_best.driver_id").alias("driver_id"),
        F.col("_best.km").alias("pickup_km"),
    )


# ---- FIFO matching -------------------------------------------------------------

#: f(riders, drivers, distances, radius) -> assignments
Policy = Callable[[DataFrame, DataFrame, DataFrame, float], DataFrame]

POLICIES: dict[str, Policy] = {"nearest_driver": match_in_rounds}


def _distance_matrix(distances: DataFrame) -> np.ndarray:
    """Zone distances as an array; the table is bounded by the zone domain squared."""
    size = ZONE_MAX + 1
    km = np.full((size, size), np.inf)
    for row in known_distances(distances).collect():
        km[row.zone_a, row.zone_b] = row.km
    return km


def by_tick(choose: Callable) -> Policy:
    """A policy from f(riders of a tick, drivers of a tick, km matrix, radius) on pandas frames.

    Every tick is one group, so this is for policies that need a whole tick at once.
    """

    def run(riders: DataFrame, drivers: DataFrame, distances: DataFrame, radius_km: float) -> DataFrame:
        km = _distance_matrix(distances)
        # few bytes but much work per row: keep all partitions, AQE would merge them
        tasks = int(riders.sparkSession.conf.get("spark.sql.shuffle.partitions"))

        def decided(key, waiting: pd.DataFrame, idle: pd.DataFrame) -> pd.DataFrame:
            if waiting.empty or idle.empty:
                return pd.DataFrame(columns=["tick", "rider_id", "driver_id", "pickup_km"])
            out = choose(waiting, idle, km, radius_km)
            out.insert(0, "tick", key[0])
            return out

        def dealt(df: DataFrame, *columns: str):
            return df.select("tick", *columns).repartition(tasks, "tick").groupBy("tick")

        return (
            dealt(riders, "rider_id", "zone", "request_ts", "rider_pos")
            .cogroup(dealt(drivers, "driver_id", "zone", "driver_pos"))
            .applyInPandas(decided, ASSIGNMENT_DDL)
        )

    return run


def register_policy(name: str, policy: Policy) -> None:
    POLICIES[name] = policy


def policy_named(name: str) -> Policy:
    if name not in POLICIES:
        raise KeyError(f"no dispatch policy is called {name!r}, only {sorted(POLICIES)}")
    return POLICIES[name]


def assign_fifo(
    riders: DataFrame,
    drivers: DataFrame,
    distances: DataFrame,
    radius_km: float = RADIUS_KM,
    policy: str = "nearest_driver",
) -> DataFrame:
    """Assignments per tick without double booking, by the named policy.

    The default serves riders in request order, each by the closest free driver within the
    radius (ties to the last in input order), in rounds of proposals.
    """
    return policy_named(policy)(riders, drivers, distances, radius_km)

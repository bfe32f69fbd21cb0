"""Seeded arrivals, fleet placement and destinations.

Every draw is a function of (seed, key): the rows do not depend on partitioning and
a lost task recomputes the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import ZONE_MAX, ZONE_MIN
from ..functions import clock
from ..functions.numbers import uniform
from .profile import expected_arrivals

# Poisson counts are drawn for pieces of at most this expectation, where
# exp(-expected) is far from underflow and the search below is short.
PIECE = 16.0


def _poisson_count(u: Column, mean: Column) -> Column:
    """Smallest k with CDF(k) >= u, for means up to ``PIECE``.

    Most pieces end at 0; the others walk the terms up to ten deviations out.
    """
    reach = F.ceil(mean + F.sqrt(mean) * 10.0).cast("int") + 20
    start = F.struct(
        F.exp(-mean).alias("pmf"), F.exp(-mean).alias("cdf"), F.lit(0).cast("long").alias("k")
    )

    def step(state: Column, i: Column) -> Column:
        pmf = state.getField("pmf") * mean / i
        return F.struct(
            pmf.alias("pmf"),
            (state.getField("cdf") + pmf).alias("cdf"),
            F.when(state.getField("cdf") < u, i.cast("long"))
            .otherwise(state.getField("k"))
            .alias("k"),
        )

    walk = F.aggregate(F.sequence(F.lit(1), reach), start, step, lambda s: s.getField("k"))
    return F.when(u <= F.exp(-mean), F.lit(0).cast("long")).otherwise(walk)


def arrival_pieces(
    profile: DataFrame, zones: DataFrame, start: Column, end: Column, seed: int
) -> DataFrame:
    """Zone-hour slices cut into short pieces, each with its Poisson count ``n``."""
    slices = expected_arrivals(profile, zones, start, end).where(F.col("expected") > 0)
    cut = F.ceil(F.col("expected") / PIECE).cast("int")
    pieces = (
        slices.withColumn("_cuts", cut)
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1)))
        .withColumn("piece_min", F.col("minutes") / F.col("_cuts"))
        .withColumn("_mean", F.col("expected") / F.col("_cuts"))
    )
    u = uniform(seed, "zone_id", clock.micros(F.col("slice_start")).cast("string"), "piece")
    return (
        pieces.withColumn("_u", u)
        .withColumn("n", _poisson_count(F.col("_u"), F.col("_mean")))
        .select("zone_id", "slice_start", "piece", "piece_min", "n")
    )


def sample_arrivals(
    profile: DataFrame, zones: DataFrame, start: Column, end: Column, seed: int
) -> DataFrame:
    """Rider arrivals of a piecewise-constant Poisson process per zone.

    Offsets are uniform inside each piece; order is left to the consumer.
    """
    pieces = arrival_pieces(profile, zones, start, end, seed).where(F.col("n") > 0)
    rows = pieces.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    u = uniform(
        seed, "zone_id", clock.micros(F.col("slice_start")).cast("string"), "piece", "i"
    )
    offset = (F.col("piece") + u) * F.col("piece_min")
    return rows.select(
        "zone_id", clock.add_minutes(F.col("slice_start"), offset).alias("ts")
    )


PICK_CELLS = 1024


def _pick_table(weights: DataFrame) -> DataFrame:
    """Shares laid end to end on [0, 1) and cut into cells: (cell, from, to, zone).

    Weights of one zone add up, so there are at most 263 shares. A zone has one row per
    cell it touches: at most 263 + 1,024 rows in all.
    """
    known = weights.where(F.col("zone_id").between(ZONE_MIN, ZONE_MAX))
    weights = known.groupBy("zone_id").agg(F.sum("weight").alias("weight"))
    order = Window.orderBy("zone_id")
    upto = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0))
    shares = weights.withColumn("_to", upto).withColumn(
        "_from", F.coalesce(F.lag("_to").over(order), F.lit(0.0))
    )
    # the last positive share also takes what rounding leaves below 1
    last = F.max_by("zone_id", F.struct("_to", "zone_id")).over(Window.partitionBy())
    shares = shares.withColumn(
        "_to", F.when(F.col("zone_id") == last, F.lit(1.0)).otherwise(F.col("_to"))
    ).where(F.col("_from") < F.col("_to"))
    first_cell = F.floor(F.col("_from") * PICK_CELLS)
    last_cell = F.least(F.floor(F.col("_to") * PICK_CELLS), F.lit(PICK_CELLS - 1))
    return shares.select(
        F.explode(F.sequence(first_cell, last_cell)).alias("_cell"), "_from", "_to", "zone_id"
    )


def _pick(df: DataFrame, table: DataFrame, u: Column, out: str) -> DataFrame:
    """Add the zone whose share contains the draw: an equi join on the draw's cell."""
    zones = F.broadcast(table.withColumnRenamed("zone_id", out))
    drawn = df.withColumn("_u", u).withColumn(
        "_at", F.floor(F.col("_u") * PICK_CELLS)
    )
    inside = (
        (F.col("_at") == F.col("_cell"))
        & (F.col("_u") >= F.col("_from"))
        & (F.col("_u") < F.col("_to"))
    )
    return drawn.join(zones, inside).drop("_u", "_at", "_cell", "_from", "_to")


def uniform_weights(weights: DataFrame) -> DataFrame:
    """Equal shares over the same zones."""
    return weights.select(
        "zone_id", (1.0 / F.count(F.lit(1)).over(Window.partitionBy())).alias("weight")
    )


def place_fleet(
    drivers: DataFrame, weights: DataFrame, seed: int, driver: str = "driver_id"
) -> DataFrame:
    """A home zone per driver, drawn by the zone weights."""
    return _pick(drivers.select(driver), _pick_table(weights), uniform(seed, driver), "zone_id")


def draw_destinations(
    riders: DataFrame, weights: DataFrame, seed: int, rider: str = "rider_id",
    origin: str = "origin",
) -> DataFrame:
    """A destination per rider; drawn once more if it equals the origin."""
    table = _pick_table(weights)
    drawn = _pick(riders.select(rider, origin), table, uniform(seed, rider, F.lit("first")), "_d")
    drawn = _pick(drawn, table, uniform(seed, rider, F.lit("again")), "_again")
    dest = F.when(F.col("_d") != F.col(origin), F.col("_d")).otherwise(F.col("_again"))
    return drawn.select(rider, origin, dest.alias("dest"))

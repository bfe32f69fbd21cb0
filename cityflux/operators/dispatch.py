"""Drivers in rings of distance, and greedy matching in rounds of proposals.

Distances depend on zones only, so what a rider prefers is a list of rings: for its zone, the
zones with drivers by distance, each with the number of drivers before it. A place in that
list names a driver (its zone and its number there, last in input order first) without a
rider x driver pair. Zones equally far make one ring, whose drivers are merged by order.

Greedy matching (riders in request order each take the closest free driver) needs no
sequential group. All drivers rank riders alike, so the greedy result is the one stable
matching, which proposals reach from any ranks that are not too high: in a round every
rider asks for the driver at its rank, every driver keeps the earliest of those who ask, the
others go one rank on. Riders of a zone share their list, so a rider can never get a better
driver than the ``n``-th if ``n`` riders of its zone come before it: ranks start there, and
whenever one grows, the later riders of the zone move up with it. Who is refused passes over the
drivers that earlier riders ask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import RADIUS_KM
from ..functions.clock import floor_micros
from ..session import scratch_path
from .geo import known_distances
from .skew import join_spread

#: rounds planned into one job; riders of a zone above which moving up goes by stretches
ROUNDS, STRETCH = 4, 4096
#: drivers that a refused rider looks at in one round, at most
AHEAD = 256


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _numbered(df: DataFrame, order: list[Column], bucket: Column) -> DataFrame:
    """``df`` with ``place``: rows of the same tick and zone before each, counted from 0.

    ``bucket`` cuts a hot zone into parts that follow each other in the order.
    """
    rows = df.withColumn("_bucket", bucket)
    key = ["tick", "zone", "_bucket"]
    before = Window.partitionBy("tick", "zone").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(*key, F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    placed = rows.repartition(*key).withColumn("_inner", inner).join(sizes, key)
    return placed.withColumn("place", F.col("_before") + F.col("_inner")).drop("_bucket", "_before", "_inner")


def placed_drivers(drivers: DataFrame) -> DataFrame:
    """``drivers`` with their ``place`` in their zone, last in input order first."""
    pos = F.col("driver_pos")
    return _numbered(drivers, [pos.desc()], -F.shiftright(pos.cast("long"), 12))


def _near(drivers: DataFrame, distances: DataFrame, radius_km: float) -> DataFrame:
    """tick, zone, zone_a, km, n: zones with drivers in reach of each zone."""
    reach = known_distances(distances).where(F.col("km") <= float(radius_km))
    held = drivers.groupBy("tick", F.col("zone").alias("zone_a")).agg(F.count(F.lit(1)).alias("n"))
    # the pair table is bounded by the zone domain squared
    near = held.join(F.broadcast(reach), "zone_a")
    return near.select("tick", F.col("zone_b").alias("zone"), "zone_a", "km", "n")


def rings(drivers: DataFrame, distances: DataFrame, radius_km: float) -> DataFrame:
    """tick, zone, rings, total, tied: what every zone has in reach, a row per tick and zone.

    ``rings`` is an array of (before, n, km, zone_a) by distance, at most one per zone;
    ``zone_a`` is null where several zones are equally far, and then ``tied`` is true.
    """
    one = F.when(F.count(F.lit(1)) == 1, F.min("zone_a"))
    near = _near(drivers, distances, radius_km)
    ring = near.groupBy("tick", "zone", "km").agg(F.sum("n").alias("n"), one.alias("zone_a"))
    inside = Window.partitionBy("tick", "zone").orderBy("km").rowsBetween(Window.unboundedPreceding, 0)
    ring = ring.withColumn("before", F.sum("n").over(inside) - F.col("n"))
    return ring.groupBy("tick", "zone").agg(
        F.sort_array(F.collect_list(F.struct("before", "n", "km", "zone_a"))).alias("rings"),
        F.sum("n").alias("total"),
        F.bool_or(F.col("zone_a").isNull()).alias("tied"),
    )


def tied_rings(placed: DataFrame, distances: DataFrame, radius_km: float, most: int | None = None) -> DataFrame:
    """tick, zone, km, nth, zone_a, place: the drivers of rings of several zones, merged by order.

    With ``most`` only the first so many of each ring.
    """
    near = _near(placed, distances, radius_km)
    several = near.groupBy("tick", "zone", "km").agg(F.count(F.lit(1)).alias("zones")).where("zones > 1")
    members = near.join(several, ["tick", "zone", "km"]).select("tick", "zone", "km", "zone_a")
    there = placed.select("tick", F.col("zone").alias("zone_a"), "driver_pos", "place")
    if most is not None:
        there = there.where(F.col("place") < most)
    order = Window.partitionBy("tick", "zone", "km").orderBy(F.col("driver_pos").desc())
    merged = members.join(there, ["tick", "zone_a"]).select(
        "tick", "zone", "km", (F.row_number().over(order) - 1).cast("long").alias("nth"), "zone_a", "place"
    )
    return merged if most is None else merged.where(F.col("nth") < most)


def _asked(rows: DataFrame, tied: DataFrame | None) -> DataFrame:
    """The driver at ``rank`` of each row's ``rings``: zone_a, place and km."""
    ring = F.expr("element_at(filter(rings, x -> x.before <= rank AND rank < x.before + x.n), 1)")
    rows = rows.withColumn("_ring", ring)
    rows = rows.withColumns({
        "km": F.col("_ring.km"), "zone_a": F.col("_ring.zone_a"), "nth": F.col("rank") - F.col("_ring.before")
    }).drop("_ring")
    if tied is None:
        return rows.withColumnRenamed("nth", "idx")
    # only rows of a ring of several zones look their driver up
    merged = tied.withColumnsRenamed({"zone_a": "_zone", "place": "_idx"})
    key = F.when(F.col("zone_a").isNull(), F.col("nth")).alias("nth")
    rows = rows.withColumn("_nth", F.col("nth")).withColumn("nth", key)
    rows = rows.join(merged, ["tick", "zone", "km", "nth"], "left")
    return rows.withColumns({
        "zone_a": F.coalesce("zone_a", "_zone"), "idx": F.coalesce("_idx", "_nth")
    }).drop("_zone", "_idx", "nth", "_nth")


def _moved_up(state: DataFrame, crowded: bool) -> DataFrame:
    """Ranks that grow with the place in the zone, as little higher as that needs."""
    ahead = F.col("rank") - F.col("place")
    if not crowded:
        order = Window.partitionBy("tick", "zone").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        return state.withColumn("rank", F.col("place") + F.max(ahead).over(order))
    rows = state.withColumn("_part", F.floor(F.col("place") / STRETCH))
    key = ["tick", "zone", "_part"]
    order = Window.partitionBy(*key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("tick", "zone").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    most = rows.groupBy(*key).agg(F.max(ahead).alias("_most"))
    most = most.select(*key, F.max("_most").over(before).alias("_carry"))
    rows = rows.repartition(*key).withColumn("_own", F.max(ahead).over(order)).join(most, key)
    return rows.withColumn("rank", F.col("place") + F.greatest("_own", "_carry")).drop("_part", "_own", "_carry")


def _beyond_held(lost: DataFrame, asked: DataFrame, index: DataFrame, tied, ahead: int) -> DataFrame:
    """tick, zone, place, to: the next rank of those refused, past drivers that refuse them too.

    Ranks are never too high, so a driver that an earlier rider asks goes to that rider or to one
    before it. Of the next ``ahead`` drivers those are passed over at once.
    """
    end = F.least(F.col("rank") + ahead, F.col("total") - 1)
    open_ = lost.where("rank + 1 < total").select(
        "tick", "zone", "place", "request_ts", "rider_pos", F.explode(F.sequence(F.col("rank") + 1, end)).alias("rank")
    )
    wanted = _asked(open_.join(index, ["tick", "zone"]), tied).drop("rings", "km")
    held = asked.where("NOT lost").select(
        "tick", "zone_a", "idx", F.struct("request_ts", "rider_pos").alias("_held")
    )
    me = F.struct("request_ts", "rider_pos")
    free = F.when(F.col("_held").isNull() | (me < F.col("_held")), F.col("rank"))
    met = wanted.join(held, ["tick", "zone_a", "idx"], "left").withColumn("_free", free)
    return met.groupBy("tick", "zone", "place").agg(F.coalesce(F.min("_free"), F.max("rank") + 1).alias("to"))


def _round(
    state: DataFrame, tied: DataFrame | None, crowded: bool, index: DataFrame | None = None, ahead: int = 0
) -> DataFrame:
    """One round: everybody asks, every driver keeps the earliest, the others go on.

    Lists are long, so riders take their zone's out of ``index`` only to ask and travel without it;
    without ``index`` the rows hold them.
    """
    asking = state.where("rank < total")
    listed = asking.select(*_STATE).join(index, ["tick", "zone"]) if index is not None else asking.select(*_STATE, "rings")
    asked = _asked(listed, tied).drop("rings")
    # a zone's riders ask for different drivers, so a driver is asked once per zone at most
    order = Window.partitionBy("tick", "zone_a", "idx").orderBy("request_ts", "rider_pos")
    asked = asked.withColumn("lost", F.row_number().over(order) > 1)
    if not ahead:
        return _moved_up(asked.withColumn("rank", F.col("rank") + F.col("lost").cast("long")), crowded)
    asked = _stored(asked, "asked")
    passed = _beyond_held(asked.where("lost"), asked, index, tied, ahead)
    moved = asked.join(passed, ["tick", "zone", "place"], "left")
    moved = moved.withColumn("rank", F.coalesce("to", F.col("rank") + F.col("lost").cast("long")))
    return _moved_up(moved.drop("to"), crowded)


_STATE = ["tick", "zone", "rider_id", "request_ts", "rider_pos", "place", "rank", "total"]


def match_in_rounds(
    riders: DataFrame, drivers: DataFrame, distances: DataFrame, radius_km: float = RADIUS_KM
) -> DataFrame:
    """tick, rider_id, driver_id, pickup_km: riders in request order each get the closest free driver.

    Ticks whose last round refused nobody are settled and leave; the others go on. A tick's rows
    are never in one group: proposals meet by driver, ranks by zone.
    """
    idle = drivers.select("tick", "driver_id", "zone", "driver_pos")
    placed = placed_drivers(idle)
    waiting = riders.select("tick", "rider_id", "zone", "request_ts", "rider_pos")
    waiting = _numbered(
        waiting, [F.col("request_ts"), F.col("rider_pos")], floor_micros("minute", F.col("request_ts"))
    )
    # later riders of a zone than it has drivers in reach go empty-handed
    index = _stored(rings(idle, distances, radius_km), "rings")
    reach = index.select("tick", "zone", "total", "tied")
    state = waiting.join(reach, ["tick", "zone"]).where("place < total").withColumn("rank", F.col("place"))
    state = _stored(state, "waiting")
    most, is_tied = state.agg(F.max("place"), F.bool_or("tied")).first()
    index = index.select("tick", "zone", "rings")
    crowded = (most or 0) >= STRETCH
    tied = _stored(tied_rings(placed, distances, radius_km), "tied-rings") if is_tied else None
    settled, ahead = [], 0
    while True:
        for _ in range(1 if crowded or ahead else ROUNDS):
            state = _round(state, tied, crowded, index, ahead)
        state = _stored(state, "round")
        size = state.agg(F.count(F.lit(1)).alias("rows"), F.count_if("lost").alias("lost")).first()
        going = state.where("lost").select("tick").distinct()
        settled.append(state.join(going, "tick", "left_anti"))
        if not size.lost:
            break
        # those refused look as far ahead as makes about a row per rider, if they are few
        ahead = min(AHEAD, max(8, size.rows // size.lost))
        state = state.join(going, "tick", "left_semi")
    kept = settled[0]
    for more in settled[1:]:
        kept = kept.unionByName(more)
    there = placed.select("tick", F.col("zone").alias("zone_a"), F.col("place").alias("idx"), "driver_id")
    return kept.join(there, ["tick", "zone_a", "idx"]).select(
        "tick", "rider_id", "driver_id", F.col("km").alias("pickup_km")
    )


def closest_drivers(
    riders: DataFrame, drivers: DataFrame, distances: DataFrame, k: int, radius_km: float = RADIUS_KM
) -> DataFrame:
    """tick, rider_id, nth (from 1), driver_id, pickup_km: each rider's ``k`` closest drivers in reach.

    Ties go to the driver that is last in input order. Lists are made per tick and zone, out of at
    most ``k`` drivers of each zone; riders only take their zone's list, hot zones in pieces.
    """
    idle = drivers.select("tick", "driver_id", "zone", "driver_pos")
    placed = placed_drivers(idle)
    listed = _stored(rings(idle, distances, radius_km), "rings")
    is_tied = listed.agg(F.bool_or("tied")).first()[0]
    merged = tied_rings(placed, distances, radius_km, k) if is_tied else None
    places = F.sequence(F.lit(0).cast("long"), F.least(F.lit(k), F.col("total")).cast("long") - 1)
    ranked = listed.withColumn("rank", F.explode(places))
    found = _asked(ranked, merged).select("tick", "zone", "rank", "km", "zone_a", "idx")
    there = placed.where(F.col("place") < k).select(
        "tick", F.col("zone").alias("zone_a"), F.col("place").alias("idx"), "driver_id"
    )
    lists = found.join(there, ["tick", "zone_a", "idx"]).groupBy("tick", "zone").agg(
        F.sort_array(F.collect_list(F.struct("rank", "driver_id", "km"))).alias("list")
    )
    joined = join_spread(riders, lists, ["tick", "zone"], "rider_id")
    return joined.select("tick", "rider_id", F.explode("list").alias("x")).select(
        "tick", "rider_id", (F.col("x.rank") + 1).alias("nth"), "x.driver_id", F.col("x.km").alias("pickup_km")
    )

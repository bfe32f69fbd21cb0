"""Ride event log: shape, order, lifecycle rules, outcomes and run metrics.

Per-rider facts are conditional aggregates (combined map-side), so a rider or
driver with a very long history never lands in one task; where the order inside an
entity matters, the bucketed forms of ``ordered`` are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import (
    CANCELLED,
    COMPLETED,
    DRIVER_MOVES,
    DRIVER_STATE,
    MATCHED,
    PATIENCE_MIN,
    PICKED_UP,
    REQUESTED,
    RIDER_END_STATES,
    RIDER_MOVES,
    RIDER_STATE,
)
from ..functions import clock
from ..functions.numbers import clamp, ratio
from .ordered import previous_value, running_total
from .ranks import global_quantiles

EVENT_SCHEMA = (
    ("seq", "bigint"),
    ("kind", "string"),
    ("ts", "timestamp_ntz"),
    ("rider_id", "bigint"),
    ("driver_id", "bigint"),
    ("zone_id", "bigint"),
    ("to_zone_id", "bigint"),
    ("wait_min", "double"),
)
EVENT_COLUMNS = tuple(name for name, _ in EVENT_SCHEMA)
EVENT_DDL = ", ".join(f"{name} {kind}" for name, kind in EVENT_SCHEMA)
ORDER = ("ts", "seq")
ILLEGAL_COLUMNS = ("entity", "entity_id", "seq", "ts", "kind", "from_state", "to_state")
ILLEGAL_DDL = (
    "entity string, entity_id bigint, seq bigint, ts timestamp_ntz, kind string, "
    "from_state string, to_state string"
)


def event_union(*parts: DataFrame) -> DataFrame:
    """Tables of single event kinds as one sparse log; absent fields become null."""
    wide = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return as_event_log(wide)


def as_event_log(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select(
        *[
            (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)
            for name, kind in EVENT_SCHEMA
        ]
    )


def _is(kind: str) -> Column:
    return F.col("kind") == kind


def _state(kind: Column, states: dict[str, str]) -> Column:
    return reduce(
        lambda expr, item: expr.when(kind == item[0], item[1]),
        list(states.items())[1:],
        F.when(kind == list(states)[0], states[list(states)[0]]),
    )


def event_order(
    events: DataFrame, entity: str = "rider_id", order=ORDER, out: str = "position",
    unit: str = "hour",
) -> DataFrame:
    """Number the events of each entity 1, 2, ... in causal order."""
    rows = events.where(F.col(entity).isNotNull())
    return running_total(rows, [entity], list(order), F.lit(1).cast("long"), out, unit)


# ---- one row per rider ---------------------------------------------------------


def _first(kind: str) -> Column:
    """Position of the first event of a kind, null when there is none."""
    return F.min(F.when(_is(kind), F.struct(*ORDER)))


def _rider_order(events: DataFrame) -> DataFrame:
    """Per rider: what happened, and whether it happened in order."""
    per_rider = (
        events.where(F.col("rider_id").isNotNull())
        .groupBy("rider_id")
        .agg(
            F.min_by("kind", F.struct(*ORDER)).alias("first_kind"),
            _first(MATCHED).alias("m"),
            _first(PICKED_UP).alias("p"),
            _first(COMPLETED).alias("c"),
            F.bool_or(_is(CANCELLED)).alias("gone"),
        )
    )
    starts = F.col("first_kind") == REQUESTED
    match_ok = F.coalesce(F.col("m") < F.col("p"), F.lit(True))
    pickup_ok = F.coalesce(F.col("p") < F.col("c"), F.lit(True))
    return per_rider.select(
        "rider_id",
        "gone",
        F.col("m").isNotNull().alias("matched"),
        F.col("c").isNotNull().alias("done"),
        starts.alias("starts_with_request"),
        match_ok.alias("match_before_pickup"),
        pickup_ok.alias("pickup_before_completion"),
        (starts & match_ok & pickup_ok).alias("in_order"),
    )


def lifecycle_order(events: DataFrame) -> DataFrame:
    """Per rider: request first, match before pickup, pickup before completion."""
    return _rider_order(events).drop("gone", "matched", "done")


def rider_outcome(events: DataFrame) -> DataFrame:
    """Last state per rider and whether it is an end state."""
    return (
        events.where(F.col("rider_id").isNotNull() & F.col("kind").isin(*RIDER_STATE))
        .groupBy("rider_id")
        .agg(F.max_by("kind", F.struct(*ORDER)).alias("_last"))
        .select(
            "rider_id",
            _state(F.col("_last"), RIDER_STATE).alias("state"),
        )
        .withColumn("is_terminal", F.col("state").isin(*RIDER_END_STATES))
    )


def risk_label(events: DataFrame) -> DataFrame:
    """Finished riders with ``cancelled`` = 1 or 0; riders in flight have no label."""
    return (
        rider_outcome(events)
        .where("is_terminal")
        .select("rider_id", (F.col("state") == "cancelled").cast("long").alias("cancelled"))
    )


def patience_cancels(events: DataFrame, patience_min: float = PATIENCE_MIN) -> DataFrame:
    """Requests not matched within the patience become cancellations at its end.

    A match exactly at the limit comes too late. Rider ids name one request each.
    """
    per_rider = (
        events.where(F.col("kind").isin(REQUESTED, MATCHED))
        .groupBy("rider_id")
        .agg(
            F.min(F.when(_is(REQUESTED), F.struct("ts", "zone_id"))).alias("r"),
            F.min(F.when(_is(MATCHED), F.col("ts"))).alias("match_ts"),
        )
        .where(F.col("r").isNotNull())
        .withColumn("deadline", clock.add_minutes(F.col("r.ts"), F.lit(float(patience_min))))
    )
    late = F.col("match_ts").isNull() | (F.col("match_ts") >= F.col("deadline"))
    return per_rider.where(late).select(
        "rider_id",
        F.col("r.zone_id").alias("zone_id"),
        F.col("r.ts").alias("request_ts"),
        F.col("deadline").alias("cancel_ts"),
        F.lit(float(patience_min)).alias("wait_min"),
    )


def ride_spans(events: DataFrame) -> DataFrame:
    """Per rider with both: matched x completed pairs and their summed minutes.

    The sum over all pairs is ``n_match * sum(done) - n_done * sum(match)``, so a
    repeated rider id costs two sums instead of a quadratic number of rows. Sums are
    decimal, so they are exact.
    """
    rows = events.where(F.col("kind").isin(MATCHED, COMPLETED) & F.col("rider_id").isNotNull())
    us = clock.micros(F.col("ts")).cast("decimal(20,0)")
    sums = rows.groupBy("rider_id").agg(
        F.count_if(_is(MATCHED)).alias("n_match"),
        F.count_if(_is(COMPLETED)).alias("n_done"),
        F.sum(F.when(_is(MATCHED), us)).alias("_match"),
        F.sum(F.when(_is(COMPLETED), us)).alias("_done"),
    )
    total = F.col("n_match") * F.col("_done") - F.col("n_done") * F.col("_match")
    return sums.where((F.col("n_match") > 0) & (F.col("n_done") > 0)).select(
        "rider_id",
        (F.col("n_match") * F.col("n_done")).alias("pairs"),
        total.cast("long").alias("busy_us"),
    )


# ---- checks over the whole log -------------------------------------------------


def invariants(events: DataFrame, fleet: DataFrame | None = None) -> DataFrame:
    """(invariant, violations): conservation rules of a run, all expected to be 0.

    One pass groups by rider for three rules; one ordered pass per driver gives the rest.
    """
    riders = (
        _rider_order(events)
        .agg(
            F.count_if(F.col("done") & F.col("gone")).alias("completed_and_cancelled"),
            F.count_if(F.col("matched") & F.col("gone")).alias("matched_and_cancelled"),
            F.count_if(~F.col("in_order")).alias("lifecycle_out_of_order"),
        )
    )
    # events of other kinds do not change what a driver holds
    step = F.when(_is(MATCHED), 1).when(_is(COMPLETED), -1).otherwise(0).cast("long")
    rows = events.where(F.col("driver_id").isNotNull()).select("driver_id", "ts", "seq", "kind")
    depth = running_total(rows, ["driver_id"], list(ORDER), step, "depth")
    bad = F.col("kind").isin(MATCHED, COMPLETED) & ~F.col("depth").isin(0, 1)
    drivers = depth.groupBy("driver_id").agg(F.bool_or(bad).alias("double"))
    outside = F.lit(None).cast("boolean")
    names = ["driver_double_booked"]
    if fleet is not None:
        known = fleet.select("driver_id").distinct().withColumn("_known", F.lit(True))
        drivers = drivers.join(known, "driver_id", "left")
        outside = F.col("_known").isNull()
        names.append("driver_outside_fleet")
    drivers = drivers.agg(
        F.count_if("double").alias("driver_double_booked"),
        F.count_if(outside).alias("driver_outside_fleet"),
    )
    parts = [(riders, [c for c in riders.columns]), (drivers, names)]
    listed = [
        df.select(
            F.explode(
                F.array(*[F.struct(F.lit(c).alias("invariant"), F.col(c).alias("violations")) for c in cs])
            ).alias("r")
        ).select("r.*")
        for df, cs in parts
    ]
    return reduce(DataFrame.unionByName, listed)


def booking_depth(events: DataFrame, unit: str = "hour") -> DataFrame:
    """Rides a driver holds after each match or completion; legal values are 0 and 1."""
    rows = events.where(
        F.col("kind").isin(MATCHED, COMPLETED) & F.col("driver_id").isNotNull()
    ).select("driver_id", "ts", "seq", "kind")
    step = F.when(_is(MATCHED), F.lit(1)).otherwise(F.lit(-1)).cast("long")
    return running_total(rows, ["driver_id"], list(ORDER), step, "depth", unit)


def double_booking(events: DataFrame, unit: str = "hour") -> DataFrame:
    """Per driver: range of the booking depth and events that leave {0, 1}."""
    return (
        booking_depth(events, unit)
        .groupBy("driver_id")
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.min("depth").alias("min_depth"),
            F.max("depth").alias("max_depth"),
            F.count_if(~F.col("depth").isin(0, 1)).alias("bad_events"),
        )
    )


def state_moves(events: DataFrame) -> DataFrame:
    """ts, seq, kind, entity, entity_id, to_state: a row per event and entity that it moves."""
    kind = F.col("kind")
    moves = [
        F.when(
            kind.isin(*states) & F.col(own).isNotNull(),
            F.struct(
                F.lit(entity).alias("entity"),
                F.col(own).alias("entity_id"),
                _state(kind, states).alias("to_state"),
            ),
        )
        for entity, own, states in (
            ("rider", "rider_id", RIDER_STATE), ("driver", "driver_id", DRIVER_STATE)
        )
    ]
    moved = F.explode(F.array_compact(F.array(*moves))).alias("m")
    return events.select("ts", "seq", "kind", moved).select("ts", "seq", "kind", "m.*")


def _legal(moves) -> Column:
    step = F.concat_ws(">", "from_state", "to_state")
    return step.isin(*[f"{a}>{b}" for a, b in moves])


def illegal_moves(moves: DataFrame) -> DataFrame:
    """Of moves with the state before them (``from_state``, null for none) those against the lifecycle.

    A rider starts by waiting; a driver starts idle.
    """
    before, after = F.col("from_state"), F.col("to_state")
    rider = F.col("entity") == "rider"
    start = F.when(rider, before).otherwise(F.coalesce(before, F.lit("idle")))
    illegal = (
        F.when(rider & before.isNull(), after != "waiting")
        .when(rider, ~_legal(RIDER_MOVES))
        .otherwise(~_legal(DRIVER_MOVES))
    )
    return moves.withColumn("from_state", start).where(illegal).select(*ILLEGAL_COLUMNS)


def illegal_transitions(events: DataFrame, unit: str = "hour") -> DataFrame:
    """Events that move a rider or driver against the lifecycle."""
    moves = previous_value(
        state_moves(events), ["entity", "entity_id"], list(ORDER), F.col("to_state"), "from_state", unit
    )
    return illegal_moves(moves)


# ---- run metrics ---------------------------------------------------------------


def driver_idle(events: DataFrame, n_drivers, horizon_min) -> Column:
    """Share of the fleet's time without a ride, as one number; 0 without drivers or time."""
    busy = ride_spans(events).agg((F.sum("busy_us") / 60_000_000.0).alias("busy")).scalar()
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    capacity = as_col(n_drivers).cast("double") * as_col(horizon_min).cast("double")
    idle = clamp(1.0 - F.coalesce(busy, F.lit(0.0)) / capacity, 0.0, 1.0)
    return F.when(capacity > 0, idle).otherwise(0.0)


def ride_metrics(events: DataFrame, n_drivers, horizon_min) -> DataFrame:
    """Eight service metrics of a run as one row.

    ``n_drivers`` and ``horizon_min`` are numbers or columns (e.g. a subquery).
    Rides without a completion are not busy time. The exact wait percentiles are found
    first, by a few counting jobs over the log, which should be a stored table.
    """
    waits = events.where(_is(MATCHED)).select("wait_min")
    found = global_quantiles(waits, "wait_min", WAIT_QUANTILES)
    wait = F.when(_is(MATCHED) & ~F.isnan("wait_min"), F.col("wait_min"))
    counts = events.agg(
        F.count_if(_is(REQUESTED)).alias("requests"),
        F.count_if(_is(COMPLETED)).alias("rides_completed"),
        F.count_if(_is(CANCELLED)).alias("cancellations"),
        F.avg(wait).alias("mean_wait_min"),
    )
    return metrics_row(counts, found, driver_idle(events, n_drivers, horizon_min))


#: wait percentiles of a run: name -> (method, share)
WAIT_QUANTILES = {"median_wait_min": ("linear", 0.5), "p90_wait_min": ("linear", 0.9)}


def metrics_row(counts: DataFrame, quantiles: dict[str, float | None], idle: Column) -> DataFrame:
    """The metrics from one row of counts with the mean wait, the percentiles and the idle share."""
    return counts.select(
        "requests",
        "rides_completed",
        "cancellations",
        ratio(F.col("cancellations"), F.col("requests")).alias("cancel_rate"),
        F.coalesce("mean_wait_min", F.lit(0.0)).alias("mean_wait_min"),
        *[F.lit(float(quantiles[name] or 0.0)).alias(name) for name in WAIT_QUANTILES],
        idle.alias("driver_idle_pct"),
    )


def rounded_metrics(metrics: DataFrame) -> DataFrame:
    """Metrics as exported: the rate to 4 places, the others to 3."""
    places = {
        "cancel_rate": 4,
        "mean_wait_min": 3,
        "median_wait_min": 3,
        "p90_wait_min": 3,
        "driver_idle_pct": 3,
    }
    return metrics.withColumns({c: F.bround(c, n) for c, n in places.items()})

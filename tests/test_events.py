from datetime import timedelta

import pytest
from frames import at
from pyspark.sql import functions as F

from cityflux.constants import CANCELLED, COMPLETED, MATCHED, PICKED_UP, REPOSITIONED, REQUESTED
from cityflux.operators import events as ev

T0 = at("2023-01-04 08:00")
DDL = ev.EVENT_DDL


def log_frame(spark, rows):
    """(minute, kind, rider, driver, zone, wait) in emission order."""
    return spark.createDataFrame(
        [
            (i, kind, T0 + timedelta(minutes=m), rider, driver, zone, None, wait)
            for i, (m, kind, rider, driver, zone, wait) in enumerate(rows)
        ],
        DDL,
    )


def small_run():
    """Five riders of one evening: three served, one given up, one still waiting."""
    served = {21: (0.5, 3.5, 10.0), 22: (4.0, 1.5, 21.0), 25: (6.0, 6.0, 8.5)}  # asked, wait, ride
    rows = []
    for rider, (asked, wait, ride) in served.items():
        met = asked + wait
        rows += [
            (asked, REQUESTED, rider, None, 74, None),
            (met, MATCHED, rider, 900 + rider, None, wait),
            (met + 1.0, PICKED_UP, rider, 900 + rider, None, None),
            (met + ride, COMPLETED, rider, 900 + rider, 13, None),
        ]
    rows += [(2.0, REQUESTED, 23, None, 90, None), (10.0, CANCELLED, 23, None, 90, 8.0)]
    rows += [(26.0, REQUESTED, 24, None, 90, None)]
    return rows


@pytest.fixture(scope="module")
def log(spark):
    return log_frame(spark, small_run())


def test_metrics_by_hand(log):
    m = ev.ride_metrics(log, 2, 30.0).head()
    assert (m.requests, m.rides_completed, m.cancellations, m.cancel_rate) == (5, 3, 1, 0.2)
    assert m.mean_wait_min == pytest.approx(11 / 3)  # of waits 1.5, 3.5 and 6
    assert m.median_wait_min == 3.5
    assert m.p90_wait_min == pytest.approx(3.5 + 0.8 * 2.5)
    assert m.driver_idle_pct == pytest.approx(1 - 39.5 / 60)  # rides of 10, 21 and 8.5 minutes
    r = ev.rounded_metrics(ev.ride_metrics(log, 2, 30.0)).head()
    assert r.mean_wait_min == 3.667


def test_metrics_of_an_empty_log(log):
    m = ev.ride_metrics(log.where("false"), 0, 60.0).head()
    assert m.asDict() == {
        "requests": 0, "rides_completed": 0, "cancellations": 0, "cancel_rate": 0.0,
        "mean_wait_min": 0.0, "median_wait_min": 0.0, "p90_wait_min": 0.0, "driver_idle_pct": 0.0,
    }


def test_idle_share_is_clamped(log):
    assert ev.ride_metrics(log, 1, 10.0).head().driver_idle_pct == 0.0


def test_spans_count_all_pairs(spark):
    log = log_frame(
        spark,
        [
            (0, MATCHED, 1, 7, None, 0.0),
            (2, MATCHED, 1, 7, None, 0.0),
            (10, COMPLETED, 1, 7, 5, None),
            (20, COMPLETED, 1, 7, 5, None),
            (30, COMPLETED, 1, 7, 5, None),
            (1, MATCHED, 2, 8, None, 0.0),
        ],
    )
    (row,) = ev.ride_spans(log).collect()
    assert (row.rider_id, row.pairs) == (1, 6)
    assert row.busy_us == 60_000_000 * sum(d - m for d in (10, 20, 30) for m in (0, 2))


def test_union_fills_missing_fields(spark, log):
    parts = [
        log.where(F.col("kind") == REQUESTED).select("seq", "kind", "ts", "rider_id", "zone_id"),
        log.where(F.col("kind") == MATCHED).select(
            "seq", "kind", "ts", "rider_id", "driver_id", "wait_min"
        ),
    ]
    out = ev.event_union(*parts)
    assert out.columns == list(ev.EVENT_COLUMNS) and out.count() == 8
    assert out.where("kind = 'RiderRequested' AND driver_id IS NULL").count() == 5


def test_clean_log_breaks_nothing(spark, log):
    fleet = spark.createDataFrame([(921,), (922,), (925,)], "driver_id bigint")
    assert {r.violations for r in ev.invariants(log, fleet).collect()} == {0}
    assert ev.illegal_transitions(log).count() == 0
    assert ev.lifecycle_order(log).where("NOT in_order").count() == 0
    assert {r.rider_id: r.state for r in ev.rider_outcome(log).collect()} == {
        21: "dropped_off", 22: "dropped_off", 23: "cancelled", 24: "waiting", 25: "dropped_off",
    }
    assert {r.rider_id: r.cancelled for r in ev.risk_label(log).collect()} == {
        21: 0, 22: 0, 23: 1, 25: 0,
    }
    small = fleet.where("driver_id < 925")
    report = {r.invariant: r.violations for r in ev.invariants(log, small).collect()}
    assert report["driver_outside_fleet"] == 1


def test_order_of_equal_times_is_emission_order(spark):
    log = log_frame(
        spark,
        [
            (0, REQUESTED, 1, None, 1, None),
            (0, MATCHED, 1, 9, None, 0.0),
            (0, PICKED_UP, 1, 9, None, None),
            (0, COMPLETED, 1, 9, 2, None),
        ],
    )
    assert ev.illegal_transitions(log).count() == 0
    got = {r.kind: r.position for r in ev.event_order(log).collect()}
    assert got == {REQUESTED: 1, MATCHED: 2, PICKED_UP: 3, COMPLETED: 4}


@pytest.mark.parametrize(
    "steps, bad",
    [
        (((MATCHED, 9),), [("rider", None, "matched")]),
        (((REQUESTED, None), (REQUESTED, None)), [("rider", "waiting", "waiting")]),
        (((REQUESTED, None), (PICKED_UP, 9)),
         [("rider", "waiting", "picked_up"), ("driver", "idle", "on_trip")]),
        (((REQUESTED, None), (MATCHED, 9), (CANCELLED, None)), []),
        (((REQUESTED, None), (CANCELLED, None), (CANCELLED, None)),
         [("rider", "cancelled", "cancelled")]),
        (((REQUESTED, None), (MATCHED, 9), (PICKED_UP, 9), (CANCELLED, None)),
         [("rider", "picked_up", "cancelled")]),
    ],
)
def test_rider_moves(spark, steps, bad):
    rows = [(i, kind, 1, driver, 5, 0.0) for i, (kind, driver) in enumerate(steps)]
    got = ev.illegal_transitions(log_frame(spark, rows)).collect()
    assert sorted((r.entity, str(r.from_state), r.to_state) for r in got) == sorted(
        (e, str(f), t) for e, f, t in bad
    )


def test_driver_moves(spark):
    rows = [
        (0, REPOSITIONED, None, 9, 5, None),
        (1, MATCHED, None, 9, None, None),   # repositioning -> to_pickup is legal
        (2, COMPLETED, None, 9, 5, None),    # to_pickup -> idle is legal
        (3, REPOSITIONED, None, 9, 5, None),
        (4, PICKED_UP, None, 9, None, None), # repositioning -> on_trip is not
    ]
    got = ev.illegal_transitions(log_frame(spark, rows)).collect()
    assert [(r.seq, r.from_state, r.to_state) for r in got] == [(4, "repositioning", "on_trip")]


def test_double_booking(spark):
    rows = [
        (0, MATCHED, 1, 9, None, 0.0),
        (70, MATCHED, 2, 9, None, 0.0),
        (140, COMPLETED, 1, 9, 3, None),
        (200, COMPLETED, 2, 9, 3, None),
        (0, MATCHED, 3, 8, None, 0.0),
        (300, COMPLETED, 3, 8, 3, None),
    ]
    got = {r.driver_id: r for r in ev.double_booking(log_frame(spark, rows)).collect()}
    assert (got[9].max_depth, got[9].bad_events) == (2, 1)
    assert (got[8].min_depth, got[8].max_depth, got[8].bad_events) == (0, 1, 0)


def test_patience(spark):
    rows = [
        (0, REQUESTED, 1, None, 5, None),
        (7.9, MATCHED, 1, 9, None, 7.9),
        (0, REQUESTED, 2, None, 5, None),
        (8, MATCHED, 2, 9, None, 8.0),  # exactly at the limit: too late
        (0, REQUESTED, 3, None, 6, None),
    ]
    got = sorted(tuple(r) for r in ev.patience_cancels(log_frame(spark, rows)).collect())
    late = T0 + timedelta(minutes=8)
    assert got == [(2, 5, T0, late, 8.0), (3, 6, T0, late, 8.0)]


@pytest.mark.parametrize("check, scans", [(ev.illegal_transitions, 2), (ev.invariants, 3)])
def test_scans_of_the_log(spark, log, tmp_path, capsys, check, scans):
    """Riders and drivers share a pass; the ordered pass reads its rows and its edges."""
    path = str(tmp_path / "log")
    log.write.parquet(path)
    check(spark.read.parquet(path)).explain()
    assert capsys.readouterr().out.count("FileScan") <= scans

"""Streams in several batches end with the rows of the batch operators."""

from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import Window, functions as F

from cityflux.constants import COMPLETED, MATCHED, PICKED_UP, REQUESTED
from cityflux.operators import cleaning, events as ev, panel, ranks
from cityflux.sources import testdata as td
from cityflux.streaming import live, runs


def in_files(df, path, order, n=4):
    """The table as ``n`` files in time order, written one after the other."""
    share = F.ntile(n).over(Window.orderBy(order)).alias("share")
    cut = df.select("*", share).cache()
    for k in range(1, n + 1):
        cut.where(F.col("share") == k).drop("share").coalesce(1).write.mode("append").parquet(path)
    cut.unpersist()


def stream_of(spark, path, files=1):
    return runs.read_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=files)


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.fixture(scope="module")
def log_path(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "log")
    in_files(td.ride_events(td.table(spark, sf_dir, "events")), path, "ts")
    return path


def test_lifecycle_in_batches(spark, log_path):
    got = live.run_lifecycle_check(stream_of(spark, log_path), "lifecycle")
    want = ev.illegal_transitions(spark.read.parquet(log_path))
    assert want.count() > 0
    same(got.select(*ev.ILLEGAL_COLUMNS), want)


def batches_of(spark, path, *parts):
    """Files of (seq, kind, time, rider, driver), one per batch."""
    kind = "seq bigint, kind string, ts timestamp_ntz, rider_id bigint, driver_id bigint"
    for rows in parts:
        made = [(i, k, datetime.fromisoformat(t), r, d) for i, k, t, r, d in rows]
        spark.createDataFrame(made, kind).coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def test_a_silent_driver_keeps_its_state(spark, tmp_path):
    """Matched on the 1st, picked up on the 10th, others in between."""
    path = str(tmp_path / "log")
    log = batches_of(
        spark, path,
        [(1, REQUESTED, "2024-01-01T08:00", 1, None), (2, MATCHED, "2024-01-01T08:05", 1, 5)],
        [(3, REQUESTED, "2024-01-05T08:00", 2, None)],
        [(4, PICKED_UP, "2024-01-10T08:00", 1, 5), (5, PICKED_UP, "2024-01-10T09:00", 3, 6)],
    )
    got = live.run_lifecycle_check(stream_of(spark, path), "silent")
    want = ev.illegal_transitions(log)
    same(got.select(*ev.ILLEGAL_COLUMNS), want)
    assert not [r for r in got.collect() if r.entity_id == 5]


def test_late_events_within_the_delay_are_put_in_order(spark, tmp_path):
    path = str(tmp_path / "log")
    log = batches_of(
        spark, path,
        [(1, REQUESTED, "2024-01-01T07:00", 1, None), (3, PICKED_UP, "2024-01-01T07:20", 1, 5)],
        [(2, MATCHED, "2024-01-01T07:10", 1, 5), (4, COMPLETED, "2024-01-01T08:10", 1, 5)],
        [(5, REQUESTED, "2024-01-01T08:15", 2, None), (7, PICKED_UP, "2024-01-01T08:40", 2, 5)],
        [(6, MATCHED, "2024-01-01T08:20", 2, 5)],
    )
    got = live.run_lifecycle_check(stream_of(spark, path), "late")
    assert ev.illegal_transitions(log).count() == 0 and got.count() == 0


def test_events_beyond_the_delay_are_kept_aside_and_a_stopped_run_goes_on(spark, tmp_path):
    """Three runs over a folder that grows, each from the checkpoint of the one before."""
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    parts = [
        [(1, REQUESTED, "2024-01-01T07:00", 1, None), (2, MATCHED, "2024-01-01T07:05", 1, 5)],
        [(3, REQUESTED, "2024-01-01T10:00", 2, None)],
        [(4, PICKED_UP, "2024-01-01T08:00", 1, 5)],  # two hours late
        [(5, REQUESTED, "2024-01-02T00:00", 3, None), (6, COMPLETED, "2024-01-01T23:59", 3, 7)],
        [(7, COMPLETED, "2024-01-02T01:00", 1, 5)],
    ]
    for some in (parts[:2], parts[2:4], parts[4:]):
        log = batches_of(spark, path, *some)
        check = live.LifecycleCheck(spark, out, "1 hour")
        check.advance(stream_of(spark, path))
    waiting = check.found().count()
    check.finish(stream_of(spark, path))
    assert sorted((r.entity, r.entity_id, r.seq) for r in check.late().collect()) == [("driver", 5, 4), ("rider", 1, 4)]
    want = ev.illegal_transitions(log.where("seq <> 4"))
    assert want.count() > waiting
    same(check.found(), want)


def test_a_batch_never_ends_inside_a_slice(spark):
    """Slices of many files, with times that repeat; files of a slice are of one age."""
    ts = F.when(F.col("id") % 3 == 0, F.lit(9_000)).otherwise(F.col("id")) * 1_000_000
    rows = spark.range(20_000).select("id", F.timestamp_micros(ts).alias("ts"))
    small = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "8k",
             "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    path = runs.save_in_order(rows.repartition(6), "uneven", "ts")
    for k, v in before.items():
        spark.conf.set(k, v)
    got = runs.run_update(
        runs.stream_in_order(spark, path, rows.schema).groupBy(F.col("ts").alias("t")).agg(F.count("*").alias("n")), "u"
    )
    spans = got.groupBy("epoch").agg(F.min("t").alias("a"), F.max("t").alias("b")).orderBy("epoch").collect()
    assert len(spans) >= 3 and all(x.b < y.a for x, y in zip(spans, spans[1:]))
    assert got.agg(F.sum("n")).first()[0] == 20_000


def test_lifecycle_state_is_kept_by_groups_of_entities(spark, tmp_path):
    """Tasks call the state once per group, not per entity, however many entities there are."""
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    first = [(2 * r, REQUESTED, f"2024-01-01T07:{r % 60:02d}", r, None) for r in range(600)]
    then = [(2 * r + 1, MATCHED if r % 3 else PICKED_UP, "2024-01-01T12:00", r, r % 7) for r in range(600)]
    log = batches_of(spark, path, first, then, [(None, PICKED_UP, "2024-01-02T00:00", 1 << 60, (1 << 60) + 1)])
    check = live.LifecycleCheck(spark, out, groups=4)
    check.advance(stream_of(spark, path))
    check.finish(stream_of(spark, path))
    same(check.found(), ev.illegal_transitions(log))
    state = spark.read.format("statestore").option("stateVarName", "last").load(f"{out}/checkpoint")
    assert 0 < state.count() <= 2 * 4


def test_slices_are_written_by_many_tasks_in_time_order(spark, sf_dir):
    events = td.table(spark, sf_dir, "events").select("ts", "event_id")
    small = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "8k",
             "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    path = runs.save_in_order(events.repartition(6), "slices", "ts")
    for k, v in before.items():
        spark.conf.set(k, v)
    stream = runs.stream_in_order(spark, path, events.schema)
    got = runs.run_update(stream.groupBy(F.lit(1).alias("k")).agg(F.max("ts").alias("t"), F.count("*").alias("n")), "s")
    steps = [(r.t, r.n) for r in got.orderBy("epoch").collect()]
    assert len(steps) >= 3 and steps == sorted(steps) and steps[-1][1] == events.count()
    whole = spark.read.parquet(path).select("*", F.input_file_name().alias("f"))
    spans = whole.groupBy("f").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).orderBy("a").collect()
    assert len(spans) > 4 and all(x.b <= y.a for x, y in zip(spans, spans[1:]))


def close(a, b):
    (x,), (y,) = a.collect(), b.collect()
    assert x.asDict() == pytest.approx(y.asDict(), rel=1e-12, nan_ok=True)


def test_metrics_are_exact_after_every_batch(spark, log_path, tmp_path):
    metrics = live.LiveMetrics(spark, str(tmp_path / "out"))
    metrics.advance(stream_of(spark, log_path))
    files = sorted(Path(log_path).glob("*.parquet"), key=lambda p: p.stat().st_mtime)
    assert len(files) == 4
    for epoch in range(4):
        log = spark.read.parquet(*map(str, files[: epoch + 1]))
        close(metrics.metrics(log, 15, 43200.0, epoch), ev.ride_metrics(log, 15, 43200.0))
    log = spark.read.parquet(log_path)
    close(metrics.metrics(log, 15, 43200.0), ev.ride_metrics(log, 15, 43200.0))
    # counts per cell, not per event; the percentiles read the waits of few cells
    assert metrics.tallies().count() <= 6 + log.select("wait_min").distinct().count()


def test_metrics_with_odd_waits(spark, tmp_path):
    inf, nan = float("inf"), float("nan")
    waits = [0.0, -0.0, -1.5, 3.0, 3.0000001, nan, None, inf, 1e300, 5e-324, 2.0**40, 7.25] * 3 + [-inf]
    path = str(tmp_path / "log")
    when = datetime(2024, 1, 1)
    rows = [(k, MATCHED, when, k, 5, None, None, w) for k, w in enumerate(waits)]
    rows += [(100, REQUESTED, when, 1, None, 3, None, None)]
    kind = "seq long, kind string, ts timestamp_ntz, rider_id long, driver_id long, zone_id long, to_zone_id long, wait_min double"
    log = spark.createDataFrame(rows, kind)
    for part in (log.where("seq < 20"), log.where("seq >= 20")):
        part.coalesce(1).write.mode("append").parquet(path)
    metrics = live.LiveMetrics(spark, str(tmp_path / "out"))
    metrics.advance(stream_of(spark, path))
    got, want = (x.collect()[0].asDict() for x in (metrics.metrics(log, 0, 1.0), ev.ride_metrics(log, 0, 1.0)))
    assert got == pytest.approx(want, nan_ok=True)
    cells = log.select("wait_min", ranks.rank_cell(F.col("wait_min")).alias("cell")).collect()
    known = sorted((r.wait_min, r.cell) for r in cells if r.cell is not None)
    assert [c for _, c in known] == sorted(c for _, c in known) and len(known) == len(waits) - 6
    empty = live.LiveMetrics(spark, str(tmp_path / "none"))
    none = str(tmp_path / "nothing")
    log.limit(0).write.parquet(none)
    empty.advance(stream_of(spark, none))


def test_patience_in_batches(spark, log_path, tmp_path):
    log = spark.read.parquet(log_path)
    last = ev.patience_cancels(log).agg(F.max("request_ts")).head()[0]
    path = str(tmp_path / "log")
    in_files(log.where(F.col("ts") <= last), path, "ts")  # ends with an open request
    got = runs.run_append(live.live_patience_cancels(stream_of(spark, path)), "patience")
    want = ev.patience_cancels(spark.read.parquet(path))
    assert 0.9 * want.count() < got.count() < want.count()
    same(live.finish_patience(got, spark.read.parquet(path)).select(want.columns), want)


def test_hourly_counts_in_batches(spark, sf_dir, tmp_path):
    events = td.table(spark, sf_dir, "events").select("ts", F.col("user_id").alias("zone"))
    path = str(tmp_path / "events")
    in_files(events, path, "ts")
    updates = runs.run_update(
        live.live_hourly_counts(stream_of(spark, path), "zone", "ts"), "hourly"
    )
    same(live.latest_counts(updates).select("zone_id", "ts", "pickups"),
         panel.hourly_counts(events, "zone", "ts").select("zone_id", "ts", "pickups"))


def test_unique_trips_in_batches(spark, sf_dir, tmp_path):
    raw = td.raw_trips(td.table(spark, sf_dir, "events"))
    path = str(tmp_path / "raw")
    in_files(raw, path, "tpep_pickup_datetime")
    stream = live.live_unique_trips(stream_of(spark, path), td.START, td.END)
    want = cleaning.clean_trips(spark.read.parquet(path), td.START, td.END)
    same(runs.run_append(stream, "unique"), want)

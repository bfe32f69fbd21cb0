"""Subscribers of one stream see what the batch operators see."""

import pytest
from pyspark.sql import functions as F
from test_streaming import in_files, stream_of

from cityflux.constants import CANCELLED, REQUESTED
from cityflux.operators import events as ev
from cityflux.sources import testdata as td
from cityflux.streaming.observers import EventBus


def keep(out, table):
    """A subscriber that stores what it makes of each batch under the batch's number."""
    return lambda batch, epoch: table(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")


def test_subscribers_equal_batch_metrics_and_failures_lose_nothing(spark, sf_dir, tmp_path):
    path = str(tmp_path / "log")
    in_files(td.ride_events(td.table(spark, sf_dir, "events")), path, "ts")
    log = spark.read.parquet(path)
    tallies, lost, broken = str(tmp_path / "tallies"), str(tmp_path / "lost"), []

    def sometimes(batch, epoch):
        if epoch == 1 and len(broken) < 2:
            broken.append(epoch)
            raise OSError("storage is away")
        keep(lost, lambda b: b.select("rider_id", "ts", "kind"))(batch, epoch)

    bus = EventBus(spark, str(tmp_path / "bus"))
    bus.subscribe("tallies", keep(tallies, lambda b: b.groupBy("kind").count()))
    bus.subscribe("lost", sometimes, [CANCELLED, REQUESTED])
    with pytest.raises(ValueError):
        bus.subscribe("lost", sometimes)
    bus.advance(stream_of(spark, path))
    assert broken == [1, 1] and not bus.failures
    counts = spark.read.parquet(tallies).groupBy("kind").agg(F.sum("count").alias("n"))
    n = {r.kind: r.n for r in counts.collect()}
    want = ev.ride_metrics(log, 1, 1.0).collect()[0]
    assert (n[REQUESTED], n[CANCELLED]) == (want.requests, want.cancellations)
    seen = spark.read.parquet(lost).select("rider_id", "ts", "kind")
    wanted = log.where(F.col("kind").isin(CANCELLED, REQUESTED)).select("rider_id", "ts", "kind")
    assert seen.exceptAll(wanted).isEmpty() and wanted.exceptAll(seen).isEmpty()
    # what all have taken is gone, but for the newest batch
    assert bus._kept() == [3]


def test_a_subscriber_that_stays_broken_goes_on_in_a_later_run(spark, tmp_path):
    path, out = str(tmp_path / "log"), str(tmp_path / "bus")
    got = {"whole": [], "broken": []}

    def take(name):
        return lambda batch, epoch: got[name].extend(r.seq for r in batch.collect())

    def fail(batch, epoch):
        raise RuntimeError("not today")

    for run, handler in enumerate((fail, fail, take("broken"))):
        rows = [(2 * run + k, REQUESTED) for k in range(2)]
        spark.createDataFrame(rows, "seq long, kind string").coalesce(1).write.mode("append").parquet(path)
        bus = EventBus(spark, out)
        bus.subscribe("whole", take("whole"))
        bus.subscribe("broken", handler)
        bus.advance(stream_of(spark, path))
        assert sorted(bus.failures) == (["broken"] if handler is fail else [])
    assert got == {"whole": list(range(6)), "broken": list(range(6))}

"""Trip and event-log operators on streams; each agrees with its batch form.

Streams use TIMESTAMP event time (the session zone is UTC) and give back naive
timestamps.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..constants import CANCELLED, COMPLETED, MATCHED, PATIENCE_MIN, REQUESTED
from ..functions import clock
from ..operators.cleaning import CleaningRules, filter_trips
from ..operators.events import (
    WAIT_QUANTILES,
    driver_idle,
    illegal_moves,
    metrics_row,
    patience_cancels,
    state_moves,
)
from ..operators.ranks import octave, rank_cell, summary_quantiles
from ..session import scratch_path
from ..sources import files


# Tasks get the processor by value: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _event_time(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def live_hourly_counts(
    stream: DataFrame, zone: str, ts: str, delay: str = "1 hour"
) -> DataFrame:
    """Pickups per zone and tumbling hour, in update mode; state ends with the watermark."""
    timed = _event_time(stream, ts, delay)
    counts = timed.groupBy(F.window(ts, "1 hour").alias("w"), F.col(zone).alias("zone_id"))
    return counts.agg(F.count(F.lit(1)).alias("pickups")).select(
        "zone_id", F.col("w.start").cast("timestamp_ntz").alias("ts"), "pickups"
    )


def latest_counts(updates: DataFrame) -> DataFrame:
    """Final count per zone and hour: counts only grow, so it is the largest."""
    return updates.groupBy("zone_id", "ts").agg(F.max("pickups").alias("pickups"))


def live_tallies(stream: DataFrame) -> DataFrame:
    """Running counts per kind and, for matches, per cell of their wait, with the waits' sum.

    The state holds a row per kind and per cell that occurs, so it is bounded by the cells of
    a double (see ``rank_cell``), not by the events.
    """
    cell = F.when(F.col("kind") == MATCHED, rank_cell(F.col("wait_min"))).alias("cell")
    return stream.select("kind", cell, "wait_min").groupBy("kind", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("cell").isNotNull(), F.col("wait_min"))).alias("waits")
    )


class LiveMetrics:
    """Run metrics over a stream, exact after every batch.

    Two queries read the stream: one keeps ``live_tallies`` in its state, the other lays the waits
    out by power of two, sorted by cell. The percentiles' ranks name a cell each in the
    summary; only the waits of these cells are read again.
    """

    def __init__(self, spark: SparkSession, out: str) -> None:
        self.spark, self.out = spark, out

    def advance(self, stream: DataFrame) -> None:
        """Take in what the stream has that was not there before."""
        waits = stream.where(F.col("kind") == MATCHED).select(
            rank_cell(F.col("wait_min")).alias("cell"), F.col("wait_min").cast("double").alias("wait_min")
        )
        waits = waits.where(F.col("cell").isNotNull()).withColumn("octave", octave(F.col("cell")))

        def lay_out(batch: DataFrame, epoch: int) -> None:
            rows = batch.sortWithinPartitions("octave", "cell", "wait_min")
            rows.write.mode("overwrite").partitionBy("octave").parquet(f"{self.out}/waits/epoch={epoch}")

        def keep(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.out}/tallies/epoch={epoch}")

        for name, rows, mode, save in (
            ("waits", waits, "append", lay_out), ("tallies", live_tallies(stream), "update", keep)
        ):
            query = (
                rows.writeStream.outputMode(mode)
                .option("checkpointLocation", f"{self.out}/checkpoint-{name}")
                .trigger(availableNow=True)
                .foreachBatch(save)
                .start()
            )
            query.awaitTermination()

    def _read(self, part: str, schema: str, epoch: int | None) -> DataFrame:
        rows = self.spark.read.schema(f"{schema}, epoch BIGINT").parquet(f"{self.out}/{part}")
        return rows if epoch is None else rows.where(F.col("epoch") <= epoch)

    def tallies(self, epoch: int | None = None) -> DataFrame:
        """The summary after a batch (the last, if none is named): counts only grow."""
        rows = self._read("tallies", "kind STRING, cell BIGINT, n BIGINT, waits DOUBLE", epoch)
        return rows.groupBy("kind", "cell").agg(F.max_by(F.struct("n", "waits"), "n").alias("s")).select(
            "kind", "cell", "s.*"
        )

    def metrics(self, log: DataFrame, n_drivers, horizon_min, epoch: int | None = None) -> DataFrame:
        """One row of run metrics after a batch; ``log`` gives the rides' spans."""
        last = self.tallies(epoch)
        rows = self._read("waits", "cell BIGINT, wait_min DOUBLE, octave INT", epoch)
        cells = last.where(F.col("cell").isNotNull()).select("cell", "n")
        found = summary_quantiles(cells, rows, "wait_min", WAIT_QUANTILES)

        def seen(kind: str) -> Column:
            return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0).cast("long"))

        counts = last.agg(
            seen(REQUESTED).alias("requests"),
            seen(COMPLETED).alias("rides_completed"),
            seen(CANCELLED).alias("cancellations"),
            (F.sum("waits") / F.sum(F.when(F.col("cell").isNotNull(), F.col("n")))).alias("mean_wait_min"),
        )
        return metrics_row(counts, found, driver_idle(log, n_drivers, horizon_min))


def run_live_metrics(stream: DataFrame, label: str, log: DataFrame, n_drivers, horizon_min) -> DataFrame:
    """Run metrics over a bounded stream."""
    live = LiveMetrics(stream.sparkSession, scratch_path(stream.sparkSession, label))
    live.advance(stream)
    return live.metrics(log, n_drivers, horizon_min)


def live_patience_cancels(
    stream: DataFrame, patience_min: float = PATIENCE_MIN, delay: str = "10 minutes"
) -> DataFrame:
    """Cancellations as soon as the watermark passes a request's deadline.

    Requests whose patience has not run out when the input ends are still open;
    ``finish_patience`` adds them.
    """
    limit = F.expr(f"INTERVAL {int(round(patience_min * 60))} SECONDS")
    requests = _event_time(
        stream.where(F.col("kind") == REQUESTED).select(
            F.col("rider_id"), "zone_id", F.col("ts").alias("request_ts")
        ),
        "request_ts",
        delay,
    )
    matches = _event_time(
        stream.where(F.col("kind") == MATCHED).select(
            F.col("rider_id").alias("m_rider"), F.col("ts").alias("match_ts")
        ),
        "match_ts",
        delay,
    )
    joined = requests.join(
        matches,
        (F.col("rider_id") == F.col("m_rider"))
        & (F.col("match_ts") >= F.col("request_ts"))
        & (F.col("match_ts") < F.col("request_ts") + limit),
        "leftOuter",
    )
    request = F.col("request_ts").cast("timestamp_ntz")
    return joined.where(F.col("m_rider").isNull()).select(
        "rider_id",
        "zone_id",
        request.alias("request_ts"),
        (request + limit).alias("cancel_ts"),
        F.lit(float(patience_min)).alias("wait_min"),
    )


def live_unique_trips(
    raw: DataFrame, start, end, rules: CleaningRules = CleaningRules(), delay: str = "1 hour"
) -> DataFrame:
    """Cleaned trips without repeats that arrive within the delay.

    Copies are first dropped per input partition group, so that a trip with very many
    copies does not send all of them to one task; the second round is the exact one.
    """
    columns = [
        "pickup_ts", "dropoff_ts", "pu_location_id", "do_location_id", "trip_distance",
        "passenger_count",
    ]
    trips = _event_time(filter_trips(raw, start, end, rules), "pickup_ts", delay)
    salted = trips.withColumn("_salt", F.spark_partition_id() % 32)
    unique = (
        salted.dropDuplicatesWithinWatermark([*columns, "_salt"])
        .dropDuplicatesWithinWatermark(columns)
        .withColumn("pickup_ts", F.col("pickup_ts").cast("timestamp_ntz"))
    )
    return unique.select(
        *columns,
        clock.minutes_between(F.col("pickup_ts"), F.col("dropoff_ts")).alias("duration_min"),
    )


def finish_patience(found: DataFrame, log: DataFrame, patience_min: float = PATIENCE_MIN,
                    delay: str = "10 minutes") -> DataFrame:
    """``found`` and the cancellations of requests still open when the input ended.

    Only the end of the log can hold them: the watermark, which each side of the join has
    of its own, has passed everything earlier.
    """
    span = F.expr(f"INTERVAL {int(round(2 * patience_min * 60))} SECONDS") + F.expr(f"INTERVAL {delay}")
    ends = log.where(F.col("kind").isin(REQUESTED, MATCHED)).groupBy("kind").agg(F.max("ts").alias("t"))
    newest = ends.agg(F.min("t").alias("t")).select(F.col("t").cast("timestamp_ntz")).scalar()
    tail = patience_cancels(log.where(F.col("ts") >= newest - span), patience_min)
    return found.unionByName(tail.join(found, ["rider_id", "request_ts"], "left_anti"))


# ---- lifecycle check -----------------------------------------------------------

_EVENTS = "seq BIGINT, kind STRING, ts TIMESTAMP_NTZ, rider_id BIGINT, driver_id BIGINT"
_MOVES = (
    "entity STRING, entity_id BIGINT, us BIGINT, seq BIGINT, kind STRING, from_state STRING, "
    "to_state STRING, is_late BOOLEAN"
)
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: groups of riders and of drivers that share a key of the state; the same for a checkpoint's life
GROUPS = 256
_GIVEN = (
    "entity STRING, entity_id BIGINT, us BIGINT, seq BIGINT, has_seq BOOLEAN, kind STRING, from_state STRING, "
    "to_state STRING, is_late BOOLEAN"
)
#: stands for a missing time: earlier than any watermark
_NO_TIME = -(1 << 63)
#: a time that moves the watermark past every event
_END = "9000-01-01 00:00:00"


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all()


class InOrder(StatefulProcessor):
    """Gives every move the state of its entity before it, in the order of event times.

    A key is a group of entities, so that a call to the state serves many of them: a group's
    moves wait as packed tables until a timer says that the watermark has passed the first,
    and the states after the last moves given out, which never expire, are one packed table. A
    move that comes when the watermark has passed its time cannot be put in order any more
    and is given out as late.
    """

    columns = ["entity_id", "us", "seq", "has_seq", "kind", "to_state"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "moves BINARY")
        self.next = handle.getValueState("next", "us BIGINT")
        self.last = handle.getValueState("last", "states BINARY")

    def _given(self, key, moves: pd.DataFrame, before, is_late: bool) -> pd.DataFrame:
        out = moves[self.columns].copy()
        out.insert(0, "entity", key[0])
        out.insert(6, "from_state", before)
        out["is_late"] = is_late
        return out

    def _wait(self, us: int) -> None:
        self.next.update((us,))
        self.handle.registerTimer(us // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        new = []
        for part in rows:
            is_late = part["us"] // 1000 < mark
            if is_late.any():
                yield self._given(key, part[is_late], None, True)
                part = part[~is_late]
            if len(part):
                new.append(part[self.columns])
        if new:
            packed = [(_packed(pa.Table.from_pandas(p, preserve_index=False)),) for p in new]
            self.waiting.appendList(packed)
            first = min(int(p["us"].min()) for p in new)
            if not self.next.exists() or first < self.next.get()[0]:
                self._wait(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        if not self.next.exists() or self.next.get()[0] // 1000 >= mark:
            return
        moves = pa.concat_tables([_unpacked(x[0]) for x in self.waiting.get()]).to_pandas()
        is_due = moves["us"] // 1000 < mark
        due, rest = moves[is_due], moves[~is_due]
        due = due.sort_values(["entity_id", "us", "has_seq", "seq", "kind", "to_state"], ignore_index=True)
        states = pd.Series(dtype=object)
        if self.last.exists():
            told = _unpacked(self.last.get()[0]).to_pandas()
            states = pd.Series(told["state"].to_numpy(), told["entity_id"].to_numpy())
        first = ~due["entity_id"].duplicated()
        before = due["to_state"].shift().where(~first, due["entity_id"].map(states))
        yield self._given(key, due, before.astype(object).where(before.notna(), None), False)
        ends = due[~due["entity_id"].duplicated(keep="last")]
        kept = states[~states.index.isin(ends["entity_id"])]
        ids = np.concatenate([kept.index.to_numpy(np.int64), ends["entity_id"].to_numpy(np.int64)])
        now = pa.array([*kept, *ends["to_state"]], pa.string())
        self.last.update((_packed(pa.table({"entity_id": ids, "state": now.dictionary_encode()})),))
        if len(rest):
            self.waiting.put([(_packed(pa.Table.from_pandas(rest, preserve_index=False)),)])
            self._wait(int(rest["us"].min()))
        else:
            self.waiting.clear()
            self.next.clear()

    def close(self) -> None:
        pass


def moves_in_order(stream: DataFrame, delay: str, groups: int = GROUPS) -> DataFrame:
    """The moves of riders and drivers with the state before each, once the watermark (the newest
    time less ``delay``) has passed them. Which rows name whom, and what state a kind of event
    means, are columns; only the waiting and the order are in the processor. Moves without a
    time are late."""
    timed = _event_time(stream.select("seq", "kind", "ts", "rider_id", "driver_id"), "ts", delay)
    # without the time column itself late rows reach the processor, which tells them apart;
    # tasks see numbers without nulls, which pandas would make floats
    moves = state_moves(timed).select(
        "entity",
        F.pmod(F.xxhash64("entity_id"), F.lit(groups)).alias("part"),
        "entity_id",
        F.coalesce(F.unix_micros("ts"), F.lit(_NO_TIME)).alias("us"),
        F.coalesce("seq", F.lit(0)).cast("long").alias("seq"),
        F.col("seq").isNotNull().alias("has_seq"),
        "kind",
        "to_state",
    )
    given = moves.groupBy("entity", "part").transformWithStateInPandas(
        statefulProcessor=InOrder(), outputStructType=_GIVEN, outputMode="append", timeMode="eventTime"
    )
    return given.withColumns({
        "seq": F.when(F.col("has_seq"), F.col("seq")), "us": F.nullif("us", F.lit(_NO_TIME))
    }).drop("has_seq")


class LifecycleCheck:
    """Illegal moves over a stream, as the batch operator finds them, whatever batch brings an event.

    All state is in the query's state store under ``out``: a run that was stopped goes on from
    its checkpoint, also in another session. ``finish`` ends the input: one last batch moves
    the watermark past everything that still waits. Entities are dealt to ``groups`` keys, a
    number that has to stay the same for a checkpoint.
    """

    def __init__(self, spark: SparkSession, out: str, delay: str = "1 hour", groups: int = GROUPS) -> None:
        self.spark, self.out, self.delay, self.groups = spark, out, delay, groups
        self.ends = f"{out}/ends"
        if not files.exists(spark, self.ends):
            spark.createDataFrame([], _EVENTS).write.parquet(self.ends)

    def advance(self, stream: DataFrame) -> None:
        """Take in what the stream has that was not there before."""
        names = [x.split()[0] for x in _EVENTS.split(", ")]
        ends = self.spark.readStream.schema(_EVENTS).parquet(self.ends)
        moves = moves_in_order(stream.select(*names).unionByName(ends), self.delay, self.groups)
        before = self.spark.conf.get(_PROVIDER)
        self.spark.conf.set(_PROVIDER, _ROCKSDB)
        try:
            query = (
                moves.writeStream.format("parquet")
                .outputMode("append")
                .option("path", f"{self.out}/moves")
                .option("checkpointLocation", f"{self.out}/checkpoint")
                .trigger(availableNow=True)
                .start()
            )
            query.awaitTermination()
        finally:
            self.spark.conf.set(_PROVIDER, before)

    def finish(self, stream: DataFrame) -> None:
        end = self.spark.range(1).select(
            *[F.lit(None).cast("bigint").alias(c) for c in ("seq", "rider_id", "driver_id")],
            F.lit(None).cast("string").alias("kind"),
            F.lit(_END).cast("timestamp_ntz").alias("ts"),
        )
        end.write.mode("append").parquet(self.ends)
        self.advance(stream)

    def _moves(self) -> DataFrame:
        moves = self.spark.read.schema(_MOVES).parquet(f"{self.out}/moves")
        return moves.withColumn("ts", F.timestamp_micros("us").cast("timestamp_ntz")).drop("us")

    def found(self) -> DataFrame:
        return illegal_moves(self._moves().where("NOT is_late"))

    def late(self) -> DataFrame:
        """Moves that came too late to be judged."""
        return self._moves().where("is_late").select("entity", "entity_id", "ts", "seq", "kind", "to_state")


def run_lifecycle_check(stream: DataFrame, label: str, delay: str = "1 hour") -> DataFrame:
    """Illegal moves of riders and drivers over a bounded stream, as the batch operator
    finds them, if no event is later than ``delay``."""
    check = LifecycleCheck(stream.sparkSession, scratch_path(stream.sparkSession, label), delay)
    check.advance(stream)
    check.finish(stream)
    return check.found()

"""Subscribers of one event stream.

A stream is read once. Every batch is first written to shared storage, then handed to each
subscriber in turn; each has a cursor of its own there. A subscriber that fails keeps its
cursor, so it gets the batches it missed, in order, before the next one, while the others go
on. Batches that all have taken are removed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..sources import files

#: f(events of a batch, its number); a batch may come again after a failure
Handler = Callable[[DataFrame, int], None]


@dataclass(frozen=True)
class Subscriber:
    name: str
    handle: Handler
    kinds: tuple[str, ...] | None = None


class Progress(StreamingQueryListener):
    """Rows and state of every finished batch of one query, as Spark reports them."""

    def __init__(self) -> None:
        self.query_id: str | None = None
        self.batches: dict[int, int] = {}
        self.ended = False

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        if str(event.progress.id) == self.query_id:
            self.batches[event.progress.batchId] = event.progress.numInputRows

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended = self.ended or str(event.id) == self.query_id


class EventBus:
    """Hands the batches of a stream to its subscribers; all it knows is under ``out``."""

    def __init__(self, spark: SparkSession, out: str) -> None:
        self.spark, self.out = spark, out
        self.subscribers: dict[str, Subscriber] = {}
        self.failures: dict[str, Exception] = {}
        self.progress = Progress()

    def subscribe(self, name: str, handle: Handler, kinds: Sequence[str] | None = None) -> None:
        """Register a subscriber, of some kinds of events or of all; names are cursors."""
        if name in self.subscribers:
            raise ValueError(f"{name!r} is subscribed already")
        self.subscribers[name] = Subscriber(name, handle, tuple(kinds) if kinds else None)

    def _cursor(self, name: str) -> int:
        """The last batch the subscriber has taken; a new one starts with the oldest kept."""
        text = files.read_text(self.spark, f"{self.out}/cursors/{name}")
        return int(text) if text else -1

    def _kept(self) -> list[int]:
        names = files.children(self.spark, f"{self.out}/events")
        return sorted(int(n.removeprefix("epoch=")) for n in names if n.startswith("epoch="))

    def _deliver(self, subscriber: Subscriber, schema) -> None:
        for epoch in self._kept():
            if epoch <= self._cursor(subscriber.name):
                continue
            batch = self.spark.read.schema(schema).parquet(f"{self.out}/events/epoch={epoch}")
            if subscriber.kinds:
                batch = batch.where(F.col("kind").isin(*subscriber.kinds))
            subscriber.handle(batch, epoch)
            files.write_text(self.spark, f"{self.out}/cursors/{subscriber.name}", str(epoch))

    def deliver(self, schema) -> None:
        """Bring every subscriber up to the newest batch; a failure stops only its own."""
        for subscriber in self.subscribers.values():
            try:
                self._deliver(subscriber, schema)
                self.failures.pop(subscriber.name, None)
            except Exception as e:  # noqa: BLE001  a subscriber's fault is its own
                self.failures[subscriber.name] = e
        taken = min((self._cursor(s) for s in self.subscribers), default=-1)
        for epoch in self._kept():
            if epoch < taken:  # the newest stays for a batch that is tried again
                files.delete(self.spark, f"{self.out}/events/epoch={epoch}")

    def advance(self, stream: DataFrame) -> Progress:
        """Take in what the stream has that was not there before."""

        def hand_out(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.out}/events/epoch={epoch}")
            self.deliver(batch.schema)

        self.progress = Progress()
        self.spark.streams.addListener(self.progress)
        try:
            query = (
                stream.writeStream.option("checkpointLocation", f"{self.out}/checkpoint")
                .trigger(availableNow=True)
                .foreachBatch(hand_out)
                .start()
            )
            self.progress.query_id = str(query.id)
            query.awaitTermination()
        finally:
            self.spark.streams.removeListener(self.progress)
        return self.progress

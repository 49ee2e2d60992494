"""Subscribing to a log: a Structured Streaming query that hands on new events in log order.

Spark's checkpoint keeps the offsets; a start position filters the first read.  A micro-batch is
sorted by position before handlers see it, and batches follow each other, so handlers see a total
order where files of the log arrive in that order.  A failing handler stops the query with its
offsets unmoved: delivery is at least once, and exactly once into the idempotent store.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from concurrent.futures import Future
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.model import EVENT_SCHEMA


class Lifecycle(Enum):
    INITIAL_CATCHUP_COMPLETED = "InitialCatchupCompleted"
    CAUGHT_UP = "CaughtUp"
    TERMINATED = "SubscriptionTerminated"


BatchHandler = Callable[[DataFrame], None]
LifecycleHandler = Callable[[Lifecycle, int | None], None]


@dataclass
class Subscription:
    """What to read, how to decode it, and who gets it.

    ``decode`` turns the log's rows into rows for the handlers (filter, parse JSON, explode into
    several); each handler gets every micro-batch as a DataFrame sorted by position.  A handler
    may write the batch anywhere; collecting it is the handler's own decision.
    """

    spark: SparkSession
    name: str
    folder: str
    handlers: list[BatchHandler]
    checkpoint: str
    start_position: int | None = None
    decode: Callable[[DataFrame], DataFrame] = lambda df: df
    on_lifecycle: LifecycleHandler = lambda event, position: None
    schema: object = EVENT_SCHEMA
    run_frequency_seconds: float = 1.0
    staleness_seconds: tuple[float, float] | None = None
    max_files_per_batch: int = 1000
    caught_up: bool = field(default=False, init=False)
    position: int | None = field(default=None, init=False)
    initial_catchup: Future = field(default_factory=Future, init=False)
    _moved: threading.Condition = field(default_factory=threading.Condition, init=False)
    _terminated: bool = field(default=False, init=False)

    def __post_init__(self):
        warning, critical = self.staleness_seconds or (5 * self.run_frequency_seconds, 30 * self.run_frequency_seconds)
        if not self.run_frequency_seconds < warning <= critical:
            raise ValueError("the staleness warning must be above the run frequency and not above the critical value")
        self.staleness_seconds = (warning, critical)

    def stream(self) -> DataFrame:
        source = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.max_files_per_batch).option("recursiveFileLookup", "false").parquet(self.folder)
        return source if self.start_position is None else source.where(F.col("position") > self.start_position)

    def _tell(self, event: Lifecycle) -> None:
        """Calls the handler, completes ``initial_catchup`` and wakes up those who wait."""
        self.on_lifecycle(event, self.position)
        with self._moved:
            if event is Lifecycle.TERMINATED:
                self._terminated = True
            else:
                self.caught_up = True
            self._moved.notify_all()
        if not self.initial_catchup.done():
            if event is Lifecycle.TERMINATED:
                self.initial_catchup.set_exception(RuntimeError(f"{self.name} ended before it had caught up"))
            else:
                self.initial_catchup.set_result(self.position)

    def _caught_up(self) -> None:
        self._tell(Lifecycle.CAUGHT_UP if self.caught_up else Lifecycle.INITIAL_CATCHUP_COMPLETED)

    def _process(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            end = batch.agg(F.max("position").alias("p")).first()["p"]
            if end is not None:
                decoded = self.decode(batch).orderBy("position")
                for handle in self.handlers:
                    handle(decoded)
                self.position = end if self.position is None else max(end, self.position)
        except Exception:
            self._tell(Lifecycle.TERMINATED)
            raise
        finally:
            batch.unpersist()

    def _process_and_tell(self, batch: DataFrame, batch_id: int) -> None:
        """A batch of a running query; tells when it reached the end of the log."""
        self._process(batch, batch_id)
        end = self.spark.read.schema(self.schema).parquet(self.folder).agg(F.max("position").alias("p")).first()["p"]
        if end is None or self.position is not None and self.position >= end:
            self._caught_up()

    def catch_up(self) -> int | None:
        """Processes all that is there, tells so, and returns the position."""
        query = self.stream().writeStream.queryName(f"{self.name}-catch-up").foreachBatch(self._process).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        self._caught_up()
        return self.position

    def start(self) -> StreamingQuery:
        """Goes on with new events until the query is stopped; ``initial_catchup`` completes at the first end of the log."""
        writer = self.stream().writeStream.queryName(self.name).foreachBatch(self._process_and_tell).option("checkpointLocation", self.checkpoint)
        return writer.trigger(processingTime=f"{int(self.run_frequency_seconds * 1000)} milliseconds").start()

    def await_position(self, position: int, timeout_seconds: float = 100.0) -> None:
        """Waits until the subscription has caught up at ``position`` or beyond.

        Raises TimeoutError, or RuntimeError if it has ended.
        """
        with self._moved:
            there = lambda: self.caught_up and self.position is not None and self.position >= position
            self._moved.wait_for(lambda: there() or self._terminated, timeout_seconds)
            if not there():
                raise RuntimeError(f"{self.name} has ended at {self.position}") if self._terminated else TimeoutError(f"{self.name} is at {self.position}, not yet at {position}")

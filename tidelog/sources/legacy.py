"""The older event table: one pretended stream, 1-based versions and effective timestamps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.text import effective_timestamp, instant_text
from tidelog.model import IncompatibleNewEvent, WrongExpectedVersion
from tidelog.operators.append import number
from tidelog.sources.store import LogStore


def from_legacy(table: DataFrame, category: str = "all", id_: str = "all", first_number: int = 0) -> DataFrame:
    """(version, effective_timestamp, event_type, body) as a log.

    Event numbers are version - 1; with ``first_number`` 1 they are the version itself, as the
    oldest adapter has them.  The metadata holds the effective timestamp.
    """
    ts = F.col("effective_timestamp").cast("timestamp")
    return table.select(
        F.col("version").alias("position"),
        ts.alias("timestamp"),
        F.lit(category).alias("stream_category"),
        F.lit(id_).alias("stream_id"),
        (F.col("version") - 1 + first_number).alias("event_number"),
        "event_type",
        F.col("body").alias("data"),
        F.concat(F.lit('{"effective_timestamp":"'), instant_text(ts), F.lit('"}')).cast("binary").alias("metadata"),
    )


def to_legacy(log: DataFrame, now=None) -> DataFrame:
    """A log as the older table; the effective timestamp comes from the metadata, or is ``now``."""
    text = F.col("metadata").cast("string")
    fallback = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return log.select(F.col("position").alias("version"), effective_timestamp(text, fallback).alias("effective_timestamp"), "event_type", F.col("data").alias("body"))


def page(table: DataFrame, after: int = 0, size: int | None = None) -> DataFrame:
    """Rows of versions above ``after``, in order; the first ``size`` of them."""
    rows = table.where(F.col("version") > after).orderBy("version")
    return rows if size is None else rows.limit(size)


TABLE = "version long, effective_timestamp timestamp, event_type string, body binary"


class LegacyStore:
    """The older table under ``folder``, with its writers.

    Events are (type, body[, metadata]); the effective timestamp comes from the metadata or is ``now``.
    """

    def __init__(self, spark: SparkSession, folder: str, now=None, stream: tuple[str, str] = ("all", "all")):
        self.spark, self.folder, self.now, self.stream = spark, folder.rstrip("/"), now, stream
        self._guard = LogStore(spark, self.folder)

    @property
    def table(self) -> DataFrame:
        return self.spark.read.schema(TABLE).parquet(f"{self.folder}/table") if self._guard.exists("table") else self.spark.createDataFrame([], TABLE)

    def log(self, first_number: int = 0) -> DataFrame:
        return from_legacy(self.table, *self.stream, first_number)

    def page(self, after: int = 0, size: int | None = None) -> DataFrame:
        """Rows of versions above ``after``, in order; the first ``size`` of them."""
        return page(self.table, after, size)

    def read_stream(self, category: str, id_: str, after: int = -1) -> DataFrame:
        """The pretended stream; there is no other."""
        self._own(category, id_)
        return self.log().where(F.col("event_number") > after).orderBy("event_number")

    def _own(self, category: str, id_: str) -> None:
        if (category, id_) != self.stream:
            raise ValueError(f"this store has one stream, {'/'.join(self.stream)}, not {category}/{id_}")

    def _version(self) -> int:
        return self.table.agg(F.max("version")).first()[0] or 0

    def _add(self, new: DataFrame) -> None:
        """Appends new events with the versions that follow: max + 1 and on."""
        placed = number(self.log(), new)
        rows = to_legacy(placed, self.now)
        rows.select("version", "effective_timestamp", "event_type", F.col("body").cast("binary").alias("body")).write.mode("append").parquet(f"{self.folder}/table")

    def append(self, new: DataFrame) -> None:
        """Appends new events (``ord``, the pretended stream, type, data, metadata)."""
        with self._guard.locked():
            self._add(new)

    def _new(self, events: Sequence[tuple]) -> DataFrame:
        return self._guard.events(*self.stream, events)

    def save(self, events: Sequence[tuple], expected_version: int | None = None) -> None:
        """Appends; at another version than the expected one nothing is written."""
        with self._guard.locked():
            current = self._version()
            if expected_version is not None and current != expected_version:
                raise WrongExpectedVersion(current, expected_version)
            if events:
                self._add(self._new(events))

    def save_auto_increment(self, events: Sequence[tuple], expected_version: int | None = None) -> None:
        """Appends with versions that the table gives; an expected version can't be asked for."""
        if expected_version is not None:
            raise ValueError("versions are given by the table; there is no expected version")
        self.save(events)

    def save_idempotently(self, events: Sequence[tuple], expected_version: int = 0) -> int:
        """Appends the events that aren't stored yet after ``expected_version``; the stored ones must be equal."""
        with self._guard.locked():
            current = self._version()
            if current < expected_version:
                raise WrongExpectedVersion(current, expected_version)
            new = self._new(events).withColumn("version", F.col("ord") + expected_version + 1)
            differ = (F.col("o.event_type") != F.col("n.event_type")) | (F.col("o.body") != F.col("n.data"))
            bad = self.table.alias("o").join(new.alias("n"), "version").where(differ).select(F.min("version")).first()[0]
            if bad is not None:
                raise IncompatibleNewEvent(f"version {bad} differs from the stored event")
            rest = events[max(0, current - expected_version) :]
            if rest:
                self._add(self._new(rest))
            return len(rest)

    def write(self, category: str, id_: str, events: Sequence[tuple], expected_version: int | None = None, metadata: bool = True) -> None:
        """Writes to the pretended stream, whose version is one less than the table's.

        Without ``metadata``, as by the oldest adapter, events must have none.
        """
        self._own(category, id_)
        if not metadata and any(len(e) > 2 and e[2] for e in events):
            raise ValueError("this store keeps no metadata")
        self.save(events, None if expected_version is None else expected_version + 1)

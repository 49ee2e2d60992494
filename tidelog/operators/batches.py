"""Batches of an archive: numbering, which are complete, and what describes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.positional import running


def batched(log: DataFrame, size: int) -> DataFrame:
    """Adds ``batch`` (from 0): ``size`` events each, in log order."""
    placed = running(log, {"_n": ("count", None)})
    return placed.withColumn("batch", F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n")


def batch_statistics(log: DataFrame) -> DataFrame:
    """One row per batch, as stored beside its object."""
    last = lambda c: F.max_by(c, "position")
    return log.groupBy("batch").agg(
        F.min("position").alias("min_position"),
        F.max("position").alias("max_position"),
        F.count("*").alias("event_count"),
        last("timestamp").alias("last_timestamp"),
        last("stream_category").alias("last_category"),
        last("stream_id").alias("last_stream_id"),
        last("event_type").alias("last_event_type"),
    )


def complete_batches(log: DataFrame, size: int, last_position: int | None = None) -> DataFrame:
    """Batches that may be archived: full ones, and the one with ``last_position`` of a dead store."""
    statistics = batch_statistics(log)
    full = F.col("event_count") == size
    if last_position is not None:
        full = full | (F.col("max_position") == last_position)
    return statistics.where(full)


def is_stale(live: Column, archived: Column, size: int) -> Column:
    """Whether the archive (null: empty) is over three batches behind."""
    return (live > 3 * size) & (archived.isNull() | (live - archived > 3 * size))

"""Reading a log: the whole, categories or one stream, in either direction, from an exclusive start.

Filters are plain comparisons on columns, so they reach the Parquet scan; the "last event"
readers are a top-1, not a sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.model import EMPTY_STREAM, STREAM, NoSuchStream


def read_all_forwards(log: DataFrame, after: int | None = None) -> DataFrame:
    return (log if after is None else log.where(F.col("position") > after)).orderBy("position")


def read_all_backwards(log: DataFrame, before: int | None = None) -> DataFrame:
    return (log if before is None else log.where(F.col("position") < before)).orderBy(F.desc("position"))


def read_last_event(log: DataFrame) -> DataFrame:
    """No or one row."""
    return log.orderBy(F.desc("position")).limit(1)


def in_categories(log: DataFrame, *categories: str) -> DataFrame:
    """The categories count as a set: naming one twice doesn't repeat its events."""
    return log.where(F.col("stream_category").isin(*set(categories)))


def in_stream(log: DataFrame, category: str, id_: str) -> DataFrame:
    return log.where((F.col("stream_category") == category) & (F.col("stream_id") == id_))


def read_category_forwards(log: DataFrame, category: str, after: int | None = None) -> DataFrame:
    return read_all_forwards(in_categories(log, category), after)


def read_categories_forwards(log: DataFrame, categories: Sequence[str], after: int | None = None) -> DataFrame:
    return read_all_forwards(in_categories(log, *categories), after)


def read_category_backwards(log: DataFrame, category: str, before: int | None = None) -> DataFrame:
    return read_all_backwards(in_categories(log, category), before)


def read_last_event_in_category(log: DataFrame, category: str) -> DataFrame:
    return read_last_event(in_categories(log, category))


def last_event_per_category(log: DataFrame) -> DataFrame:
    return _last(log, ["stream_category"], "position")


def last_event_per_stream(log: DataFrame) -> DataFrame:
    return _last(log, STREAM, "event_number")


def _last(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """An aggregate: partial results are combined before the shuffle, so hot keys don't matter."""
    rest = F.struct(*(c for c in log.columns if c not in keys))
    best = log.groupBy(*keys).agg(F.max_by(rest, order).alias("_last"))
    return best.select(*keys, "_last.*").select(*log.columns)


def stream_exists(log: DataFrame, category: str, id_: str) -> bool:
    return not in_stream(log, category, id_).limit(1).isEmpty()


def require_stream(log: DataFrame, category: str, id_: str) -> None:
    if not stream_exists(log, category, id_):
        raise NoSuchStream(f"{category}/{id_}")


def read_stream_forwards(log: DataFrame, category: str, id_: str, after: int = EMPTY_STREAM) -> DataFrame:
    """Raises :class:`NoSuchStream` at once, not when the result is used."""
    require_stream(log, category, id_)
    return in_stream(log, category, id_).where(F.col("event_number") > after).orderBy("event_number")


def read_stream_backwards(log: DataFrame, category: str, id_: str, before: int | None = None) -> DataFrame:
    require_stream(log, category, id_)
    own = in_stream(log, category, id_)
    return (own if before is None else own.where(F.col("event_number") < before)).orderBy(F.desc("event_number"))


def read_last_event_in_stream(log: DataFrame, category: str, id_: str) -> DataFrame:
    require_stream(log, category, id_)
    return in_stream(log, category, id_).orderBy(F.desc("event_number")).limit(1)


def stream_versions(log: DataFrame) -> DataFrame:
    """The last event number of each stream."""
    return log.groupBy(*STREAM).agg(F.max("event_number").alias("version"))


def stream_version(log: DataFrame, category: str, id_: str) -> int:
    """-1 for a stream without events."""
    return in_stream(log, category, id_).agg(F.coalesce(F.max("event_number"), F.lit(EMPTY_STREAM)).alias("v")).first()["v"]


def version_at(log: DataFrame, cutoff, effective: str = "effective_timestamp") -> DataFrame:
    """One row: the last version whose effective timestamp is before ``cutoff``, or 0."""
    return log.where(F.col(effective) < cutoff).agg(F.coalesce(F.max("position"), F.lit(0)).alias("version"))

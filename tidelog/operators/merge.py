"""Merging logs by a key, as if their heads were compared one by one.

An input isn't sorted by the key in general.  Once an event leaves its input, the events behind
it with lower keys follow at once; so each event counts with the running maximum of the keys in
its input, and the merge is a sort by (running maximum, input, position).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.text import effective_timestamp
from tidelog.operators.positional import balanced_bucket, position_bucket, running


@dataclass(frozen=True)
class Input:
    """A named log and the position after which it is read."""

    name: str
    log: DataFrame
    after: int | None = None

    def rows(self) -> DataFrame:
        return self.log if self.after is None else self.log.where(F.col("position") > self.after)


def checked_names(inputs: list[Input]) -> list[str]:
    names = [i.name.strip() for i in inputs]
    if not all(names):
        raise ValueError("input names must not be empty")
    if len(set(names)) != len(names):
        raise ValueError(f"input names must be unique: {names}")
    return names


def by_effective_timestamp(fall_back_to_timestamp: bool = False) -> Column:
    """Merge key: the effective timestamp of the metadata."""
    text = F.col("metadata").cast("string")
    return effective_timestamp(text, F.col("timestamp").cast("timestamp") if fall_back_to_timestamp else None)


class StreamIndex:
    """Marks the merge of one input after the other."""


def by_stream_index() -> StreamIndex:
    """Input 0 as a whole, then input 1, and so on."""
    return StreamIndex()


def within_horizon(log: DataFrame, snapshot: Column, by: list[str], ts: str = "timestamp") -> DataFrame:
    """Per input the events before the first one later than ``snapshot``, even if older ones follow."""
    late = log.where(F.col(ts) > snapshot).groupBy(*by).agg(F.min("position").alias("_late"))
    joined = log.join(late, by, "left")
    return joined.where(F.col("_late").isNull() | (F.col("position") < F.col("_late"))).drop("_late")


def merge(
    inputs: list[Input],
    key: Column | StreamIndex,
    snapshot: Column | None = None,
    positions: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """The inputs' events with ``input_idx``, ``merge_key`` and ``merge_rank`` (from 1).

    Ties go to the input listed first.  ``snapshot``: see :func:`within_horizon`.  With
    ``positions`` each row also has, per input, the last position taken so far (``position_<name>``,
    at first the input's start, null for the beginning).  ``key`` may be a number or a timestamp.
    """
    names = checked_names(inputs)
    parts = [i.rows().withColumn("input_idx", F.lit(k)) for k, i in enumerate(inputs)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p, allowMissingColumns=True)
    constant = isinstance(key, StreamIndex)
    union = union.withColumn("_key", F.lit(0) if constant else key)
    if snapshot is not None:
        union = within_horizon(union, snapshot, ["input_idx"])
    keyed = running(union, {"merge_key": ("max", "_key")}, by=["input_idx"]).drop("_key")
    kind = dict(keyed.dtypes)["merge_key"]
    time_like = kind.startswith("timestamp")
    # For constant or numeric keys the input and its position range cut the order.
    order = ["merge_key", "input_idx", "position"] if time_like or kind in ("bigint", "int", "double") else None
    if order is None:
        raise TypeError(f"merge keys must be timestamps or numbers, not {kind}")
    if constant:
        ranked = running(keyed, {"_in": ("count", None)}, by=["input_idx"])
        sizes = keyed.groupBy("input_idx").agg(F.count("*").alias("_n"))
        before = sizes.select(F.col("input_idx").alias("_i"), F.col("_n").alias("_m"))
        offsets = sizes.join(before, F.col("_i") < F.col("input_idx"), "left").groupBy("input_idx").agg(F.coalesce(F.sum("_m"), F.lit(0)).alias("_offset"))  # a row per input
        ranked = ranked.join(F.broadcast(offsets), "input_idx").withColumn("merge_rank", F.col("_in") + F.col("_offset")).drop("_in", "_offset")
    else:
        # A late event gives all behind it its key: buckets are cut by rows, not by time.
        bucket = balanced_bucket(keyed, "merge_key", ["input_idx", "position"], buckets)
        ranked = running(keyed, {"merge_rank": ("count", None)}, order=order, bucket=bucket)
    if not positions:
        return ranked
    last = {f"position_{n}": ("last", F.when(F.col("input_idx") == k, F.col("position"))) for k, n in enumerate(names)}
    placed = running(ranked, last, order=["merge_rank"], bucket=position_bucket("merge_rank"))
    starts = {f"position_{n}": F.coalesce(F.col(f"position_{n}"), F.lit(i.after)) for n, i in zip(names, inputs)}
    return placed.withColumns(starts)


def merge_until_first_dry(inputs: list[Input], key: Column, now: Column, delay_seconds: int) -> DataFrame:
    """The older merge: one horizon, ``now`` less the delay, for keys rather than write times."""
    horizon = now - F.make_dt_interval(secs=F.lit(delay_seconds))
    return merge([Input(i.name, i.log.where(key <= horizon), i.after) for i in inputs], key)

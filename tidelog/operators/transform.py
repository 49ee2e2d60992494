"""Operators from log to log: filter, transform, backdate, rekey, reorder, and their composition."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.text import effective_timestamp_text
from tidelog.model import stream_id
from tidelog.operators.positional import balanced_bucket, running
from tidelog.operators.reads import read_last_event

Op = Callable[[DataFrame], DataFrame]
EPOCH = "1970-01-01T00:00:00Z"


def flow(*ops: Op) -> Op:
    """The operators one after the other, left to right; without any, the identity."""
    return lambda log: reduce(lambda d, op: d.transform(op), ops, log)


def filtering(predicate: Column) -> Op:
    return lambda log: log.where(predicate)


def containing_event_types(*types: str) -> Op:
    return filtering(F.col("event_type").isin(*types))


def excluding_events_before(instant) -> Op:
    """Keeps events written at ``instant`` or later."""
    return filtering(F.col("timestamp") >= instant)


def filtered_last_event(log: DataFrame, predicate: Column) -> DataFrame:
    """The log's last event if it satisfies the predicate; earlier events aren't searched."""
    return read_last_event(log).where(predicate)


def transforming(**columns: Column) -> Op:
    """Replaces columns by expressions; all rows and, unless given, positions stay."""
    return lambda log: log.withColumns(columns)


def transforming_records(function: Callable[[pd.DataFrame], pd.DataFrame]) -> Op:
    """Applies Python code to batches of rows; it must return a row for each row, positions kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            new = function(batch.copy())
            if len(new) != len(batch):
                raise ValueError("a transformation must keep every event")
            new["position"] = batch["position"].to_numpy()
            yield new

    return lambda log: log.mapInPandas(run, log.schema)


def backdating(cutover: str, destination: str = EPOCH, metadata: str = "metadata") -> Op:
    """Effective timestamps before ``cutover`` become ``destination``.

    Other fields and their order stay, and events that aren't moved keep their bytes.  Metadata
    that isn't a JSON object with a textual effective timestamp is an error.
    """
    limit = pd.Timestamp(cutover)

    @F.pandas_udf("string")
    def rewrite(column: pd.Series) -> pd.Series:
        def one(text: str) -> str:
            found = json.loads(text)
            if not isinstance(found, dict) or not isinstance(found.get("effective_timestamp"), str):
                raise ValueError(f"no effective timestamp in: {text}")
            if pd.Timestamp(found["effective_timestamp"]) >= limit:
                return text
            return json.dumps({**found, "effective_timestamp": destination}, separators=(",", ":"), ensure_ascii=False)

        return column.map(one)

    def run(log: DataFrame) -> DataFrame:
        kind = dict(log.dtypes)[metadata]
        text = F.col(metadata).cast("string")
        # Only rows that may move, or are in error, reach Python: a union, since a Python function in a
        # conditional expression would get all rows.
        own = effective_timestamp_text(text)
        simple = (own != "") & (F.try_to_timestamp(own) >= F.lit(cutover).cast("timestamp")) & (F.size(F.split(text, '"effective_timestamp"')) == 2) & text.startswith('{"effective_timestamp":')
        stays = F.coalesce(simple, F.lit(False))
        return log.where(stays).unionByName(log.where(~stays).withColumn(metadata, rewrite(text).cast(kind)))

    return run


def backdating_column(column: str, cutover: Column, destination: Column) -> Op:
    """The same for a timestamp column; stays within generated code."""
    return lambda log: log.withColumn(column, F.when(F.col(column) < cutover, destination).otherwise(F.col(column)))


def rekeying(category: str, id_: str, after_number: int = -1, width: int | None = None) -> Op:
    """Collapses the log into one stream; numbers go on after ``after_number``."""
    stream_id(category, id_)

    def run(log: DataFrame) -> DataFrame:
        bucket = None if width is None else F.floor(F.col("position") / width)
        numbered = running(log, {"_n": ("count", None)}, bucket=bucket)
        new = {"stream_category": F.lit(category), "stream_id": F.lit(id_), "event_number": F.col("_n") + after_number}
        return numbered.withColumns(new).drop("_n")

    return run


def reordering(cutoff: Column, key: str, after: int | None = None, bucket: Column | None = None) -> Op:
    """Sorts the events up to the first one whose key reaches ``cutoff`` by key, and adds ``rank``.

    The tail stays in log order.  If no key reaches the cutoff, the result is empty.  ``after``
    resumes: the event at that position and those ranked before it are left out.  Ties in the key
    keep log order.  ``bucket`` cuts the sorted part for parallel ranking; it must not decrease
    with the key (by default, ranges of about equal numbers of rows).
    """

    def run(log: DataFrame) -> DataFrame:
        first = log.where(F.col(key) >= cutoff).agg(F.min("position").alias("_first"))
        flagged = log.crossJoin(F.broadcast(first)).where(F.col("_first").isNotNull())  # one row
        tail = (F.col("position") >= F.col("_first")).cast("int")
        flagged = flagged.withColumn("_tail", tail).withColumn("_key", F.when(tail == 0, F.col(key))).drop("_first")
        place = F.floor(F.col("position") / (1 << 20)).cast("long")
        if bucket is None:
            cut = F.when(F.col("_tail") == 0, balanced_bucket(flagged.where("_tail = 0"), "_key", ["position"])).otherwise(F.struct(F.lit(0).alias("range"), place.alias("t0")))
        else:
            cut = F.when(F.col("_tail") == 0, F.coalesce(bucket, F.lit(0))).otherwise(place)
        ranked = running(flagged, {"_in": ("count", None)}, order=["_key", "position"], by=["_tail"], bucket=cut)
        head = flagged.agg(F.sum(1 - F.col("_tail")).alias("_head"))
        ranked = ranked.crossJoin(F.broadcast(head)).withColumn("rank", (F.col("_in") + F.when(F.col("_tail") == 1, F.col("_head")).otherwise(0)).cast("long"))
        ranked = ranked.drop("_tail", "_key", "_in", "_head")
        if after is None:
            return ranked
        start = ranked.where(F.col("position") == after).agg(F.min("rank").alias("_start"))
        return ranked.crossJoin(F.broadcast(start)).where(F.col("rank") > F.col("_start")).drop("_start")

    return run


def single_category(category: str) -> Op:
    return filtering(F.col("stream_category") == category)


def several_categories(*categories: str) -> Op:
    return filtering(F.col("stream_category").isin(*set(categories)))

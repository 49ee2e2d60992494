"""Copying a log: runs of equal streams, chunks of bounded size, and checkpoints in the metadata."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.positional import running
from tidelog.operators.reads import in_categories, read_last_event
from tidelog.sources.tables import written

if TYPE_CHECKING:
    from tidelog.sources.store import LogStore

MAX_BATCH = 10_000


def runs_and_chunks(log: DataFrame, stream: Column, max_batch: int = MAX_BATCH) -> DataFrame:
    """Adds ``run`` (from 1), ``offset`` in the run and ``chunk`` in the run (both from 0).

    A run is a maximal stretch of the log with one stream; it is cut into chunks of ``max_batch``.
    """
    keyed = running(log.withColumn("_stream", stream), {"_before": ("lag", "_stream")})
    starts = keyed.withColumn("_start", (~F.col("_stream").eqNullSafe(F.col("_before"))).cast("long"))
    # The place of a row and the place at which its run starts give the offset; no run is one window.
    placed = running(starts, {"run": ("sum", "_start"), "_place": ("count", None)})
    first = running(placed, {"_first": ("last", F.when(F.col("_start") == 1, F.col("_place")))})
    offset = F.col("_place") - F.col("_first")
    out = first.withColumn("offset", offset).withColumn("chunk", F.floor(F.col("offset") / max_batch).cast("long"))
    return out.drop("_stream", "_before", "_start", "_place", "_first")


def with_checkpoints(chunked: DataFrame) -> DataFrame:
    """Adds ``checkpoint``: true for the last event of each chunk."""
    place = F.struct("run", "chunk")
    ends = chunked.groupBy("run", "chunk").agg(F.max("position").alias("_end"))
    out = chunked.withColumn("_place", place).join(ends, ["run", "chunk"])
    return out.withColumn("checkpoint", F.col("position") == F.col("_end")).drop("_place", "_end")


def stamped(metadata: Column, position: Column) -> Column:
    """Adds ``shovel_position`` to a JSON object; any other text is replaced by such an object.

    The object's other text stays as it is.  No Python: a checkpoint is one row in thousands, and a
    Python function in a conditional expression would get them all.
    """
    text = F.trim(F.coalesce(metadata, F.lit("")))
    field = F.concat(F.lit('"shovel_position":"'), position.cast("string"), F.lit('"'))
    is_object = text.startswith("{") & F.try_parse_json(text).isNotNull()
    has = F.get_json_object(text, "$.shovel_position").isNotNull()
    known = r'"shovel_position"\s*:\s*"[^"]*"'
    body = F.regexp_replace(text, r"\s*\}$", "")
    added = F.concat(body, F.when(body.rlike(r"\{\s*$") & (F.length(F.regexp_replace(body, r"\s", "")) == 1), F.lit("")).otherwise(F.lit(",")), field, F.lit("}"))
    replaced = F.concat(F.regexp_extract(text, f"(?s)^(.*?){known}", 1), field, F.regexp_extract(text, f"(?s)^.*?{known}(.*)$", 1))
    return F.when(~is_object, F.concat(F.lit("{"), field, F.lit("}"))).when(has, replaced).otherwise(added)


def shovel(log: DataFrame, output_category: str | None = None, max_batch: int = MAX_BATCH) -> DataFrame:
    """The events to write: stream as redirected, event numbers kept, checkpoints stamped.

    Adds ``run``, ``chunk``, ``checkpoint`` and ``expected_version``, the version that the output
    stream must have before the chunk.
    """
    category = F.col("stream_category") if output_category is None else F.lit(output_category)
    log = log.withColumn("stream_category", category)
    out = with_checkpoints(runs_and_chunks(log, F.struct("stream_category", "stream_id"), max_batch))
    kind = dict(log.dtypes)["metadata"]
    new = F.when(F.col("checkpoint"), stamped(F.col("metadata").cast("string"), F.col("position")).cast(kind)).otherwise(F.col("metadata"))
    return out.withColumn("metadata", new).withColumn("expected_version", F.col("event_number") - 1 - F.col("offset") % max_batch).drop("offset")


def resume_position(output: DataFrame, output_category: str | None = None) -> int | None:
    """The checkpoint of the output's last event; None for an empty output."""
    own = output if output_category is None else in_categories(output, output_category)
    last = read_last_event(own).select(F.col("metadata").cast("string").alias("m")).collect()
    if not last:
        return None
    try:
        return int(json.loads(last[0]["m"])["shovel_position"])
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError(f"the last event has no shovel position: {last[0]['m']}") from e


def copy_new(log: DataFrame, store: LogStore, output_category: str | None = None, max_batch: int = MAX_BATCH) -> int:
    """Copies what ``store`` doesn't have yet, with checkpoints; returns how many events it wrote.

    It goes on from the checkpoint of the store's last event.  A chunk must meet its stream at the
    version before its first event, or repeat events that differ only in their checkpoints; so a copy
    that died is repeated without harm.
    """
    after = resume_position(store.log, output_category)
    rows = shovel(log if after is None else log.where(F.col("position") > after), output_category, max_batch)
    return store.write_numbered(written(rows, "shovel-chunks"), same_but_position)


def shovel_until_caught_up(log: Callable[[], DataFrame], store: LogStore, output_category: str | None = None, max_batch: int = MAX_BATCH) -> int:
    """Repeats :func:`copy_new` on the log as it then is until nothing is new."""
    total = 0
    while n := copy_new(log(), store, output_category, max_batch):
        total += n
    return total


def same_but_position(old: str, new: str) -> Column:
    """Compatibility of copies: type, data, and metadata without the checkpoint."""
    bare = lambda c: F.regexp_replace(F.col(f"{c}.metadata").cast("string"), r',?"shovel_position":"[^"]*"', "")
    same = (bare(old) == bare(new)) | (F.regexp_replace(bare(old), r"^\{\}$", "") == F.regexp_replace(bare(new), r"^\{\}$", ""))
    return (F.col(f"{old}.event_type") == F.col(f"{new}.event_type")) & (F.col(f"{old}.data") == F.col(f"{new}.data")) & same

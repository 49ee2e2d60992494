"""Stitching a backfill or an archive to a live log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.positions import SEPARATOR
from tidelog.operators.reads import in_categories


def stitch(backfill: DataFrame, live: DataFrame, cutoff: int, after_backfill: int | None = None, after_live: int | None = None) -> DataFrame:
    """All backfill, then the live events after ``cutoff``.

    Adds ``part`` (0 or 1) and ``stitched``, the text of the position pair: backfill events carry
    the cutoff, live events the last backfill position.  A resumed live position other than the
    cutoff means that the backfill is done.
    """
    resumed_live = after_live is not None and after_live != cutoff
    start = cutoff if after_live is None else after_live
    old = backfill.where(F.lit(False)) if resumed_live else backfill
    if after_backfill is not None:
        old = old.where(F.col("position") > after_backfill)
    end = backfill.agg(F.max("position").alias("_end"))  # one row
    old = old.withColumn("part", F.lit(0)).withColumn("stitched", F.concat(F.col("position").cast("string"), F.lit(f"{SEPARATOR}{cutoff}")))
    new = live.where(F.col("position") > start).withColumn("part", F.lit(1)).crossJoin(F.broadcast(end))
    last = F.coalesce(F.col("_end"), F.lit(after_backfill), F.lit(0)).cast("string")
    new = new.withColumn("stitched", F.concat(last, F.lit(SEPARATOR), F.col("position").cast("string"))).drop("_end")
    return old.unionByName(new)


def stitch_category(backfill: DataFrame, live: DataFrame, category: str, cutoff: int, **resume) -> DataFrame:
    return stitch(in_categories(backfill, category), in_categories(live, category), cutoff, **resume)


def archive_to_live(archive: DataFrame, live: DataFrame, max_archive: int, after: int = -1) -> DataFrame:
    """Two logs that share positions: the archive up to ``max_archive``, the live log beyond."""
    new = live.where(F.col("position") > max(after, max_archive))
    if after >= max_archive:
        return new
    return archive.where((F.col("position") > after) & (F.col("position") <= max_archive)).unionByName(new)


def stitch_legacy(backfill: DataFrame, live: DataFrame, cutoff: int, version: int = 0, streaming: bool = False) -> DataFrame:
    """Events after ``version``: the backfill's, then the live log's after max(cutoff, version).

    A plain read always includes the backfill, a streaming one only up to the cutoff.
    """
    new = live.where(F.col("position") > max(cutoff, version))
    if streaming and version > cutoff:
        return new
    return backfill.where(F.col("position") > version).unionByName(new)

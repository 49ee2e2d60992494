"""Generated logs: the passing of days, months and intervals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def periods(spark: SparkSession, start: dt.date, now: dt.datetime, months: bool = False, after: int = -1, event_type: str | None = None, category: str = "clock", id_: str = "period") -> DataFrame:
    """An event at 00:00 UTC of the start plus i days (or months), from i = ``after`` + 1 up to ``now``.

    Months count from the start date, so the 31st is cut back to shorter months but not lost.
    The index is the position and the event number; payloads are empty.
    """
    n = (now.date() - start).days if not months else (now.year - start.year) * 12 + now.month - start.month
    rows = spark.range(after + 1, max(n, after) + 1).withColumnRenamed("id", "position")
    day = F.add_months(F.lit(start), F.col("position").cast("int")) if months else F.date_add(F.lit(start), F.col("position").cast("int"))
    rows = rows.withColumn("timestamp", day.cast("timestamp")).where(F.col("timestamp") <= F.lit(now).cast("timestamp"))
    return rows.select(
        "position",
        "timestamp",
        F.lit(category).alias("stream_category"),
        F.lit(id_).alias("stream_id"),
        F.col("position").alias("event_number"),
        F.lit(event_type or ("MonthPassed" if months else "DayPassed")).alias("event_type"),
        F.lit(b"").alias("data"),
        F.lit(b"").alias("metadata"),
    )


def ticks(spark: SparkSession, last_millis: int, now_millis: int, accuracy_millis: int) -> DataFrame:
    """A tick for each whole interval since the last one; positions are epoch milliseconds.

    The stream is ``time`` with an empty id, and the event number is always -1.
    """
    n = max(0, (now_millis - last_millis) // accuracy_millis)
    position = F.lit(last_millis) + (F.col("id") + 1) * accuracy_millis
    return spark.range(n).select(
        position.alias("position"),
        F.timestamp_millis(position).alias("timestamp"),
        F.lit("time").alias("stream_category"),
        F.lit("").alias("stream_id"),
        F.lit(-1).cast("long").alias("event_number"),
        F.lit("TimePassed").alias("event_type"),
        F.lit(b"").alias("data"),
        F.lit(b"").alias("metadata"),
    )

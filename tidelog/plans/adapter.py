"""The ``events`` table as a log.

Positions are event_id + 1, a user's events are a stream, and five categories deal the users out.
Effective timestamps lie up to six hours before the write, so they aren't in log order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.positional import running

#: The same log for DuckDB, as the first common table expression.
LOG_SQL = """ev AS (
  SELECT event_id + 1 AS position, ts AS "timestamp", 'seg' || (user_id % 5) AS stream_category, cast(user_id AS varchar) AS stream_id,
         cast(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS bigint) - 1 AS event_number, event_type, props AS data,
         ts - to_hours(cast(user_id % 7 AS integer)) AS effective_ts FROM events)"""


def unnumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log without event numbers: a projection of the scan."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        (F.col("event_id") + 1).alias("position"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("seg"), (F.col("user_id") % 5).cast("string")).alias("stream_category"),
        F.col("user_id").cast("string").alias("stream_id"),
        "event_type",
        F.col("props").alias("data"),
        (F.col("ts") - F.make_interval(hours=(F.col("user_id") % 7).cast("int"))).alias("effective_ts"),
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with event numbers from 0 in each stream."""
    numbered = running(unnumbered(spark, sf_dir), {"_n": ("count", None)}, by=["stream_category", "stream_id"])
    return numbered.withColumn("event_number", F.col("_n") - 1).select("position", "timestamp", "stream_category", "stream_id", "event_number", "event_type", "data", "effective_ts")


def with_metadata(df: DataFrame) -> DataFrame:
    """Adds the metadata text with the effective timestamp."""
    text = F.date_format("effective_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return df.withColumn("metadata", F.concat(F.lit('{"effective_timestamp":"'), text, F.lit('Z"}')))


METADATA_SQL = """'{"effective_timestamp":"' || strftime(effective_ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z"}'"""

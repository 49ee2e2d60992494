"""Event tables in a database, through Spark's JDBC source; the driver jar is the user's."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.model import EVENT_COLUMNS, WrongExpectedVersion, checked
from tidelog.operators import append as appending
from tidelog.operators.append import versions_of

STORED = [c for c in EVENT_COLUMNS if c != "ts_nanos"]
TYPES = {
    "position": "BIGINT NOT NULL PRIMARY KEY",
    "timestamp": "TIMESTAMP NOT NULL",
    "stream_category": "VARCHAR(255) NOT NULL",
    "stream_id": "VARCHAR(255) NOT NULL",
    "event_number": "BIGINT NOT NULL",
    "event_type": "VARCHAR(255) NOT NULL",
    "data": "BLOB NOT NULL",
    "metadata": "BLOB NOT NULL",
}


@dataclass(frozen=True)
class JdbcEvents:
    """A table of events.  ``columns`` names those that the table calls otherwise.

    Filters on position, category, stream and number reach the database, because the log is a plain
    projection of the table.  Two writers can't take the same place: the table's keys forbid it, and
    the slower one fails.
    """

    spark: SparkSession
    url: str
    table: str
    columns: dict[str, str] = field(default_factory=dict)
    options: dict[str, str] = field(default_factory=dict)

    def _name(self, column: str) -> str:
        return self.columns.get(column, column)

    def _load(self, table: str, **options) -> DataFrame:
        return self.spark.read.format("jdbc").options(**self.options).options(**options).option("url", self.url).option("dbtable", table).load()

    def _log(self, **options) -> DataFrame:
        rows = self._load(self.table, **options)
        return rows.select(*(F.col(f"`{self._name(c)}`").alias(c) for c in STORED))

    def log(self, partitions: int = 1) -> DataFrame:
        """The table as a log; more partitions read ranges of positions in parallel."""
        if partitions == 1:
            return self._log()
        p = self._name("position")
        low, high = self._load(f"(SELECT MIN({p}) AS low, MAX({p}) AS high FROM {self.table}) bounds").first()
        if low is None or low == high:
            return self._log()
        return self._log(partitionColumn=p, lowerBound=low, upperBound=high, numPartitions=partitions)

    def page(self, after: int = -1, size: int = 100_000) -> DataFrame:
        """The next ``size`` events after a position, in order; the database sorts and limits."""
        return self._log().where(F.col("position") > after).orderBy("position").limit(size)

    def create(self) -> None:
        """Makes the table with its keys."""
        rows = ", ".join(f"{self._name(c)} {TYPES[c]}" for c in STORED)
        key = ", ".join(map(self._name, ("stream_category", "stream_id", "event_number")))
        connection = self.spark._jvm.java.sql.DriverManager.getConnection(self.url)
        try:
            connection.createStatement().executeUpdate(f"CREATE TABLE {self.table} ({rows}, UNIQUE ({key}))")
        finally:
            connection.close()

    def write(self, new: DataFrame, expected_version: int | None = None, now=None) -> None:
        """Appends new events (``ord``, stream, type, data, metadata); with a version all are of one stream."""
        log = self._log()
        if expected_version is not None:
            found = versions_of(log, new).collect()  # of the streams in ``new``: one
            current = found[0]["version"] if found else -1
            if current != expected_version:
                raise WrongExpectedVersion(current, expected_version)
        now = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
        rows = checked(appending.number(log, new)).withColumn("timestamp", now)
        rows = rows.select(*(F.col(c).alias(self._name(c)) for c in STORED))
        rows.write.format("jdbc").options(**self.options).option("url", self.url).option("dbtable", self.table).mode("append").save()


def read_events(spark: SparkSession, url: str, table: str, partitions: int = 1, **options: str) -> DataFrame:
    """The table as a log."""
    return JdbcEvents(spark, url, table, options=options).log(partitions)

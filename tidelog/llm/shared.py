"""Reading tables, and cutting lineage through the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bounds the Arrow batches between Spark and Python by bytes: texts differ in length by orders."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local session without one, as in tests, uses a folder in its warehouse; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tidelog-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it again.

    What follows restarts from the files, also after executors are lost, and runs the steps
    before only once.
    """
    path = fresh_folder(df.sparkSession, name) if folder is None else f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that an operator needs only until its result is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, fresh_folder(spark, name)

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        return cut(df, name, self.folder)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

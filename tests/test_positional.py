import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelog.operators.positional import balanced_bucket, position_bucket, running, time_bucket


@pytest.mark.parametrize("width", [1, 3, 7, 1000])
def test_equals_plain_windows(spark, width):
    rng = random.Random(width)
    rows = [(p, rng.choice("ab"), rng.choice([None, 1, 5, 9]), rng.randrange(5)) for p in sorted(rng.sample(range(200), 60))]
    df = spark.createDataFrame(rows, "position long, g string, x long, y long")
    for by in ([], ["g"]):
        got = running(df, {"n": ("count", None), "s": ("sum", "y"), "m": ("max", "x"), "l": ("last", "x"), "b": ("lag", "x")}, by=by, bucket=position_bucket(width=width))
        order = Window.partitionBy(*by).orderBy("position")
        so_far = order.rowsBetween(Window.unboundedPreceding, 0)
        want = df.withColumns({"n": F.count(F.lit(1)).over(so_far), "s": F.sum("y").over(so_far), "m": F.max("x").over(so_far), "l": F.last("x", True).over(so_far), "b": F.lag("x").over(order)})
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_order_by_time(spark):
    df = spark.sql("SELECT id AS position, timestamp '2024-01-01' + make_interval(0,0,0,0, cast((id * 37) % 100 AS int)) AS t FROM range(100)")
    got = running(df, {"n": ("count", None)}, order=["t", "position"], bucket=time_bucket("t"))
    assert [r["n"] for r in got.orderBy("t").collect()] == list(range(1, 101))


def test_no_window_without_partitions(spark):
    plan = running(spark.range(10).withColumnRenamed("id", "position").withColumn("x", F.col("position")), {"n": ("count", None)})
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "_bucket" in text


def test_unknown_kind(spark):
    with pytest.raises(ValueError):
        running(spark.range(1).withColumnRenamed("id", "position"), {"n": ("median", "position")})


def test_empty(spark):
    df = spark.createDataFrame([], "position long, x long")
    assert running(df, {"n": ("count", None), "m": ("max", "x")}).count() == 0


def test_balanced_buckets(spark):
    """Ranks of keys with an outlier that most rows share: no bucket holds them all, and the order stays."""
    rng = random.Random(1)
    rows = [(p, p % 2, 50 if p > 300 else rng.choice([None, *range(40)])) for p in range(1000)]
    df = spark.createDataFrame(rows, "position long, i long, k long")
    bucket = balanced_bucket(df, "k", ["i", "position"], parts=8, width=100)
    assert df.groupBy(bucket.alias("b")).count().agg(F.max("count")).first()[0] < 250
    got = running(df, {"n": ("count", None)}, order=["k", "i", "position"], bucket=bucket)
    want = sorted(rows, key=lambda r: (r[2] is not None, r[2], r[1], r[0]))
    assert [r["position"] for r in got.orderBy("n").collect()] == [r[0] for r in want] and sorted(r["n"] for r in got.collect()) == list(range(1, 1001))
    times = df.withColumn("k", F.timestamp_seconds(F.coalesce("k", F.lit(0))))
    got = running(times, {"n": ("count", None)}, order=["k", "position"], bucket=balanced_bucket(times, "k", ["position"], 8))
    assert [r["n"] for r in got.orderBy("k", "position").collect()] == list(range(1, 1001))
    empty = df.where("false")
    assert running(empty, {"n": ("count", None)}, order=["k", "position"], bucket=balanced_bucket(empty, "k", ["position"])).count() == 0

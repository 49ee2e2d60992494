"""The reading contract."""

import pytest
from pyspark.sql import functions as F

from tests.helpers import START, column, effective, make_log
from tidelog import model
from tidelog.operators import reads

EVENTS = [("a", "1", "A"), ("b", "1", "B"), ("a", "1", "C"), ("c", "9", "D"), ("b", "1", "E"), ("a", "2", "F")]


@pytest.fixture
def log(spark):
    return make_log(spark, EVENTS)


def test_all(log):
    assert column(reads.read_all_forwards(log), "event_type") == list("ABCDEF")
    assert column(reads.read_all_forwards(log, 4), "event_type") == ["E", "F"]
    assert column(reads.read_all_forwards(log, 6), "event_type") == []
    assert column(reads.read_all_backwards(log), "event_type") == list("FEDCBA")
    assert column(reads.read_all_backwards(log, 3), "event_type") == ["B", "A"]
    assert column(reads.read_all_backwards(log, 1), "event_type") == []
    assert column(reads.read_last_event(log), "event_type") == ["F"]


def test_categories(log):
    assert column(reads.read_category_forwards(log, "a"), "event_type") == ["A", "C", "F"]
    assert column(reads.read_category_forwards(log, "a", 1), "event_type") == ["C", "F"]
    assert column(reads.read_category_backwards(log, "b"), "event_type") == ["E", "B"]
    assert column(reads.read_category_backwards(log, "b", 5), "event_type") == ["B"]
    assert column(reads.read_categories_forwards(log, ["b", "c", "b"]), "event_type") == ["B", "D", "E"]
    assert column(reads.read_last_event_in_category(log, "b"), "event_type") == ["E"]
    assert column(reads.read_last_event_in_category(log, "z"), "event_type") == []
    assert sorted(column(reads.last_event_per_category(log), "event_type")) == ["D", "E", "F"]


def test_streams(log):
    assert column(reads.read_stream_forwards(log, "a", "1"), "event_type") == ["A", "C"]
    assert column(reads.read_stream_forwards(log, "a", "1", 0), "event_type") == ["C"]
    assert column(reads.read_stream_backwards(log, "a", "1"), "event_type") == ["C", "A"]
    assert column(reads.read_stream_backwards(log, "a", "1", 1), "event_type") == ["A"]
    assert column(reads.read_last_event_in_stream(log, "b", "1"), "event_type") == ["E"]
    assert sorted(column(reads.last_event_per_stream(log), "event_type")) == ["C", "D", "E", "F"]
    assert reads.stream_version(log, "a", "1") == 1 and reads.stream_version(log, "x", "1") == -1


@pytest.mark.parametrize("read", [reads.read_stream_forwards, reads.read_stream_backwards, reads.read_last_event_in_stream])
def test_missing_streams_fail_at_once(log, read):
    with pytest.raises(model.NoSuchStream):
        read(log, "a", "3")


def test_empty_log(spark):
    log = model.empty_log(spark)
    assert reads.read_all_forwards(log).count() == reads.read_last_event(log).count() == 0
    assert not reads.stream_exists(log, "a", "1")


def test_filters_reach_the_scan(spark, log, tmp_path):
    log.write.parquet(str(tmp_path / "log"))
    df = reads.read_category_forwards(spark.read.parquet(str(tmp_path / "log")), "a", 2).select("position", "event_type")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(position,2)" in plan and "EqualTo(stream_category,a)" in plan or "stream_category" in plan
    assert "data" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_version_at_effective_time(spark):
    df = spark.sql("SELECT id AS position, timestamp '2024-01-01' + make_interval(0,0,0,cast(id AS int)) AS effective_timestamp FROM range(1, 6)")
    at = lambda day: reads.version_at(df, F.lit(f"2024-01-0{day}").cast("timestamp")).first()["version"]
    assert [at(1), at(3), at(4)] == [0, 1, 2]


def test_model(spark):
    assert model.stream_id("a", "x-y") == ("a", "x-y")
    for bad in (("a-b", "1"), (None, "1")):
        with pytest.raises(ValueError):
            model.stream_id(*bad)
    log = make_log(spark, [("a", "1", "T")])
    assert log.select(model.locator()).first()[0] == "<a/1/0>(T)" and log.select(model.resolved_locator()).first()[0] == "@1<a/1/0>(T)"
    with pytest.raises(Exception, match="must not contain"):
        model.checked(make_log(spark, [("a-b", "1", "T")])).collect()


def test_text_functions(spark):
    from tidelog.functions import text

    df = make_log(spark, [("a", "1", "T", b"", effective("2024-01-01T00:00:00.123456Z")), ("a", "1", "T", b"", b'{"x":{"effective_timestamp" : "2023-01-01T00:00:00Z"}}'), ("a", "1", "T")])
    m = F.col("metadata").cast("string")
    assert column(df.select(text.effective_timestamp_text(m).alias("t")), "t") == ["2024-01-01T00:00:00.123456Z", "2023-01-01T00:00:00Z", ""]
    got = column(df.select(text.instant_text(text.effective_timestamp(m, F.col("timestamp"))).alias("t")), "t")
    assert got == ["2024-01-01T00:00:00.123456Z", "2023-01-01T00:00:00Z", "2024-01-01T00:00:02Z"]
    with pytest.raises(Exception, match="no effective timestamp"):
        df.select(text.effective_timestamp(m)).collect()
    assert START.isoformat() == "2024-01-01T00:00:00+00:00"
    keys = sorted(r[0] for r in spark.createDataFrame([(p,) for p in (1000, 1, 20, 3, 9999)], "p long").select(text.archive_key("s", F.col("p"))).collect())
    assert [int(k.split("/")[1][:32]) for k in keys] == [1, 3, 20, 1000, 9999]

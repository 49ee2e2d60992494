import pytest
from pyspark.sql import functions as F

from tests.helpers import by, column, effective, make_log
from tidelog.operators import transform
from tidelog.operators.clock import periods, ticks


def test_filters(spark):
    log = make_log(spark, [("a", "1", "A"), ("a", "1", "B"), ("b", "1", "A")])
    assert column(log.transform(transform.containing_event_types("A")), "position") == [1, 3]
    assert column(transform.filtered_last_event(log, F.col("event_type") == "A"), "position") == [3]
    assert column(transform.filtered_last_event(log, F.col("event_type") == "B"), "position") == []  # earlier matches aren't searched
    assert column(log.transform(transform.excluding_events_before(F.lit("2024-01-01 00:00:01").cast("timestamp"))), "position") == [2, 3]
    assert log.transform(transform.flow()).collect() == log.collect()


def test_transformations_keep_positions(spark):
    log = make_log(spark, [("a", "1", "A"), ("a", "1", "B")])
    assert column(log.transform(transform.transforming_records(lambda p: p.assign(event_type="x", position=0))), "position") == [1, 2]
    with pytest.raises(Exception, match="must keep every event"):
        log.transform(transform.transforming_records(lambda p: p.head(0))).collect()


CUT = "2024-01-01T00:00:00Z"


@pytest.mark.parametrize(
    "text, new",
    [
        (b'{"effective_timestamp":"2023-12-31T23:59:59Z"}', '{"effective_timestamp":"1970-01-01T00:00:00Z"}'),
        (b'{"a":1,"effective_timestamp":"2023-12-31T23:59:59Z","b":[2]}', '{"a":1,"effective_timestamp":"1970-01-01T00:00:00Z","b":[2]}'),
        (b'{"effective_timestamp":"2024-01-01T00:00:00Z" , "b" : 2}', '{"effective_timestamp":"2024-01-01T00:00:00Z" , "b" : 2}'),
        (b'{ "x": 1, "effective_timestamp":"2024-06-01T00:00:00Z"}', '{ "x": 1, "effective_timestamp":"2024-06-01T00:00:00Z"}'),
        (b'{"x":{"effective_timestamp":"2020-01-01T00:00:00Z"},"effective_timestamp":"2024-06-01T00:00:00Z"}', '{"x":{"effective_timestamp":"2020-01-01T00:00:00Z"},"effective_timestamp":"2024-06-01T00:00:00Z"}'),
    ],
)
def test_backdating(spark, text, new):
    log = make_log(spark, [("a", "1", "A", b"", text)])
    assert bytes(log.transform(transform.backdating(CUT)).first()["metadata"]).decode() == new


@pytest.mark.parametrize("text", [b"{}", b"[]", b'{"effective_timestamp":5}', b"x"])
def test_backdating_errors(spark, text):
    with pytest.raises(Exception):
        make_log(spark, [("a", "1", "A", b"", text)]).transform(transform.backdating(CUT)).collect()


@pytest.mark.parametrize("width", [1, 2, None])
def test_rekeying(spark, width):
    log = make_log(spark, [("a", "1", "A"), ("b", "1", "B"), ("a", "1", "C")])
    got = log.transform(transform.rekeying("all", "x", width=width))
    assert by(got, "position", "stream_category", "stream_id", "event_number") == [("all", "x", 0), ("all", "x", 1), ("all", "x", 2)]
    assert by(log.where("position > 1").transform(transform.rekeying("all", "x", 0, width)), "position", "event_number") == [1, 2]
    with pytest.raises(ValueError):
        transform.rekeying("a-b", "x")


def reorder(log, key="event_type", **more):
    return by(log.transform(transform.reordering(F.lit("AnEventCutoff"), key, bucket=F.lit(0), **more)), "rank", "position")


def test_reordering(spark):
    log = make_log(spark, [("a", "1", t) for t in ("AnEvent2", "AnEvent1", "AnEventCutoff")])
    assert reorder(log) == [2, 1, 3]
    assert reorder(make_log(spark, [("a", "1", "AnEvent")])) == []


def test_reordering_resumed(spark):
    log = make_log(spark, [("a", "1", t) for t in ("AnEvent3", "AnEvent2", "AnEvent1", "AnEventCutoff")])
    assert reorder(log) == [3, 2, 1, 4]
    assert reorder(log, after=2) == [1, 4]


def test_reordering_is_stable_and_keeps_the_tail(spark):
    log = make_log(spark, [("a", "1", t) for t in ("AnEvent2", "AnEvent1", "AnEvent2", "AnEventCutoff", "AnEvent0", "AnEventZ")])
    assert reorder(log) == [2, 1, 3, 4, 5, 6]


def test_clocks(spark):
    import datetime as dt

    at = lambda df: [f"{t:%Y-%m-%d %H:%M}" for t in by(df.withColumn("t", F.col("timestamp").cast("timestamp_ntz")), "position", "t")]
    assert at(periods(spark, dt.date(2018, 4, 1), dt.datetime(2018, 6, 4, 12), months=True)) == ["2018-04-01 00:00", "2018-05-01 00:00", "2018-06-01 00:00"]
    assert at(periods(spark, dt.date(2018, 4, 1), dt.datetime(2018, 7, 4), months=True, after=2)) == ["2018-07-01 00:00"]
    assert at(periods(spark, dt.date(2018, 6, 4), dt.datetime(2018, 6, 6))) == ["2018-06-04 00:00", "2018-06-05 00:00", "2018-06-06 00:00"]
    assert at(periods(spark, dt.date(2024, 1, 31), dt.datetime(2024, 3, 31), months=True)) == ["2024-01-31 00:00", "2024-02-29 00:00", "2024-03-31 00:00"]
    assert at(periods(spark, dt.date(2024, 1, 1), dt.datetime(2023, 1, 1))) == []
    assert ticks(spark, 0, 9_999, 10_000).count() == 0
    assert by(ticks(spark, 0, 39_999, 10_000), "position", "position", "event_number", "stream_id") == [(10_000, -1, ""), (20_000, -1, ""), (30_000, -1, "")]


def test_effective_helper():
    assert effective("x") == b'{"effective_timestamp":"x"}'

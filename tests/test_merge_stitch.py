import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import by, effective, keyed, make_log
from tidelog.functions import positions as P
from tidelog.operators import merge, stitch
from tidelog.operators.merge import Input


def greedy(inputs):
    """Takes the head with the smallest key, of equal ones that of the first input."""
    heads, out = [0] * len(inputs), []
    while any(h < len(i) for h, i in zip(heads, inputs)):
        k = min((i[h][1], n) for n, (h, i) in enumerate(zip(heads, inputs)) if h < len(i))[1]
        out.append((k, inputs[k][heads[k]][0]))
        heads[k] += 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_merge_equals_taking_heads(spark, seed):
    rng = random.Random(seed)
    inputs = [[(p, rng.randrange(8)) for p in sorted(rng.sample(range(1, 60), rng.randrange(0, 20)))] for _ in range(3)]
    named = [Input(n, keyed(spark, rows)) for n, rows in zip("abc", inputs)]
    got = merge.merge(named, F.col("k"))
    assert by(got, "merge_rank", "input_idx", "position") == greedy(inputs)
    assert by(got, "merge_rank", "merge_rank") == list(range(1, len(greedy(inputs)) + 1))


def test_vector_positions(spark):
    named = [Input("a", keyed(spark, [(5, 1), (6, 3)]), 4), Input("b", keyed(spark, [(1, 2)]))]
    got = merge.merge(named, F.col("k"), positions=True)
    assert by(got, "merge_rank", "position_a", "position_b") == [(5, None), (5, 1), (6, 1)]


def test_horizon_stops_at_the_first_late_event(spark):
    rows = [(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:09"), (3, "2024-01-01 00:00:01")]
    log = spark.createDataFrame(rows, "position long, t string").select("position", F.to_timestamp("t").alias("timestamp"))
    named = [Input("a", log)]
    at = lambda t: by(merge.merge(named, F.col("timestamp"), snapshot=F.lit(t).cast("timestamp")), "merge_rank", "position")
    assert at("2024-01-01 00:00:05") == [1] and at("2024-01-01 00:00:09") == [1, 2, 3]


def test_strategies(spark):
    a = make_log(spark, [("a", "1", "A1", b"", effective("2024-01-02T00:00:00Z")), ("a", "1", "A2", b"", effective("2024-01-04T00:00:00Z"))])
    b = make_log(spark, [("b", "1", "B1", b"", effective("2024-01-01T00:00:00Z")), ("b", "1", "B2")])
    named = [Input("a", a), Input("b", b)]
    assert by(merge.merge(named, merge.by_effective_timestamp(True)), "merge_rank", "event_type") == ["B1", "B2", "A1", "A2"]
    assert by(merge.merge(named, merge.by_stream_index()), "merge_rank", "event_type") == ["A1", "A2", "B1", "B2"]
    with pytest.raises(Exception, match="no effective timestamp"):
        merge.merge(named, merge.by_effective_timestamp()).collect()
    for names in (("a", "a"), ("a", " ")):
        with pytest.raises(ValueError):
            merge.merge([Input(n, a) for n in names], F.lit(0))


def test_merged_positions():
    codec = P.merged({"a": P.LONG, "b": P.LONG})
    assert codec.parse('{"b":"2","a":"1"}') == (1, 2) and codec.render((1, 2)) == '{"a":"1","b":"2"}'
    assert [codec.compare((1, 1), x) for x in ((1, 2), (1, 1), (0, 1))] == [-1, 0, 1]
    with pytest.raises(P.NotComparable, match="Not comparable: a:2;b:1 <=> a:1;b:2"):
        codec.compare((2, 1), (1, 2))
    for bad in ("[]", '{"a":"1"}', '{"a":"1","b":"2","c":"3"}', '{"a":"1","a":"1","b":"2"}', '{"a":1,"b":"2"}'):
        with pytest.raises(ValueError):
            codec.parse(bad)
    assert P.merged_component({"a": P.LONG, "b": P.LONG}, "b").compare((2, 1), (1, 2)) == -1


def test_stitched_and_rekeyed_positions():
    codec = P.stitched(P.LONG, P.LONG)
    assert codec.parse("3~~~5") == (3, 5) and codec.render((3, 5)) == "3~~~5"
    assert codec.compare((1, 4), (2, 4)) < 0 < codec.compare((2, 5), (2, 4))
    with pytest.raises(ValueError):
        codec.parse("3")
    codec = P.rekeyed(P.LONG)
    assert codec.parse("7:30") == (7, 30) and codec.render((7, 30)) == "7:30" and codec.compare((9, 1), (0, 2)) < 0


def test_parallel_change():
    before, after = (P.parallel_change(P.LONG, P.LONG, 10, 20, migrated=m) for m in (False, True))
    for text in ("10~~~30", "30"):
        assert before.render(before.parse(text)) == "10~~~30" and after.render(after.parse(text)) == "30"
    with pytest.raises(ValueError):
        after.render(after.parse("10~~~20"))
    with pytest.raises(ValueError):
        before.parse("1~~~2~~~3")
    assert before.compare(before.parse("5~~~20"), before.parse("30")) < 0 < before.compare(before.parse("31"), before.parse("10~~~30"))
    with pytest.raises(P.NotComparable):
        before.compare(before.parse("5~~~20"), before.parse("6~~~20"))


@pytest.fixture
def stores(spark):
    live = make_log(spark, [("a", "1", t) for t in ("old-1", "old-2", "old-3", "old-4", "L1", "L2", "L3")])
    return make_log(spark, [("a", "1", t) for t in ("B1", "B2", "B3")]), live


def test_stitching(stores):
    backfill, live = stores
    got = stitch.stitch(backfill, live, 4).orderBy("part", "position").collect()
    assert [r["event_type"] for r in got] == ["B1", "B2", "B3", "L1", "L2", "L3"]
    assert [r["stitched"] for r in got] == ["1~~~4", "2~~~4", "3~~~4", "3~~~5", "3~~~6", "3~~~7"]
    shown = lambda df: [r["event_type"] for r in df.orderBy("part", "position").collect()]
    assert shown(stitch.stitch(backfill, live, 4, after_backfill=2, after_live=4)) == ["B3", "L1", "L2", "L3"]
    assert shown(stitch.stitch(backfill, live, 4, after_backfill=3, after_live=6)) == ["L3"]
    assert shown(stitch.stitch_category(backfill, live, "z", 4)) == []


def test_archive_to_live_and_legacy(stores):
    backfill, live = stores
    shown = lambda df: sorted(r["event_type"] for r in df.collect())
    assert shown(stitch.archive_to_live(live.where("position <= 5"), live, 5, 3)) == ["L1", "L2", "L3", "old-4"]
    assert shown(stitch.archive_to_live(live.where("position <= 5"), live, 5, 6)) == ["L3"]
    assert shown(stitch.stitch_legacy(backfill, live, 4, 2)) == ["B3", "L1", "L2", "L3"]
    assert shown(stitch.stitch_legacy(backfill, live, 1, 2)) == ["B3", "L1", "L2", "L3", "old-3", "old-4"]
    assert shown(stitch.stitch_legacy(backfill, live, 1, 2, streaming=True)) == ["L1", "L2", "L3", "old-3", "old-4"]


def test_older_merge_has_one_horizon(spark):
    log = keyed(spark, [(1, "2024-01-01"), (2, "2024-01-03")], "position long, d string").select("position", F.to_timestamp("d").alias("t"))
    got = merge.merge_until_first_dry([Input("a", log)], F.col("t"), F.lit("2024-01-03").cast("timestamp"), 1)
    assert by(got, "merge_rank", "position") == [1]

import json
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from tests.helpers import by, column, effective, keyed, make_log
from tidelog.functions.jsoncompat import difference, same_bytes, same_json
from tidelog.model import IncompatibleNewEvent, WrongExpectedVersion
from tidelog.operators import append, batches, diff, shovel
from tidelog.plans import catalog
from tidelog.sources.jdbc import JdbcEvents
from tidelog.sources.legacy import LegacyStore, from_legacy, to_legacy
from tidelog.sources.store import LogStore, StoreLocked, retrying


@pytest.fixture
def store(spark, tmp_path):
    return LogStore(spark, str(tmp_path / "store"))


def stored(store):
    return by(store.log, "position", "position", "stream_id", "event_number", "event_type")


def test_append(store):
    store.write("a", "1", [("A", b"x"), ("B", b"y", b"m")])
    store.write("b", "2", [("C", b"")])
    store.write("a", "1", [("D", b"")])
    assert stored(store) == [(1, "1", 0, "A"), (2, "1", 1, "B"), (3, "2", 0, "C"), (4, "1", 2, "D")]
    assert bytes(store.log.where("position = 2").first()["metadata"]) == b"m"
    with pytest.raises(ValueError):
        store.write("a-b", "1", [("A", b"")])
    store.drop()
    assert stored(store) == []


def test_expected_versions(store):
    store.write("a", "1", [("A", b"")], expected_version=-1)
    store.write("a", "1", [("B", b"")], expected_version=0)
    for wrong in (-1, 0, 5):
        with pytest.raises(WrongExpectedVersion, match=f"current version: 1, expected version: {wrong}"):
            store.write("a", "1", [("X", b"")], expected_version=wrong)
    assert len(stored(store)) == 2


def test_execute_keeps_what_succeeds(store):
    store.write("a", "1", [("A", b""), ("B", b"")])
    with pytest.raises(WrongExpectedVersion):
        store.execute([("a", "1", [("X", b"")], 0), ("a", "2", [("C", b""), ("D", b"")], -1)])
    assert stored(store)[2:] == [(3, "2", 0, "C"), (4, "2", 1, "D")]
    with pytest.raises(ValueError, match="twice"):
        store.execute([("a", "1", [("X", b"")], None), ("a", "1", [("Y", b"")], None)])
    assert len(stored(store)) == 4


def test_concurrent_writers(store):
    threads = [threading.Thread(target=lambda t=t: [store.write("a", "1", [(f"T{t}", b"")]) for _ in range(3)]) for t in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert [r[2] for r in stored(store)] == list(range(9)) and [r[0] for r in stored(store)] == list(range(1, 10))


def test_lock_is_waited_for(store, monkeypatch):
    with store.locked(), pytest.raises(StoreLocked), store.locked(wait_seconds=0.1):
        pass


def test_idempotent_writes(store):
    events = [("A", b"1"), ("B", b"2")]
    assert store.write_idempotently("a", "1", events) == 2
    assert store.write_idempotently("a", "1", events) == 0
    assert store.write_idempotently("a", "1", [*events, ("C", b"3")]) == 1
    assert store.write_idempotently("a", "1", [("C", b"3"), ("D", b"4")], expected_version=1) == 1
    with pytest.raises(IncompatibleNewEvent):
        store.write_idempotently("a", "1", [("A", b"other")])
    with pytest.raises(WrongExpectedVersion):
        store.write_idempotently("a", "1", [("Z", b"")], expected_version=9)
    assert store.write_idempotently("a", "1", [("other", b"1")], compatible=same_bytes) == 0
    assert [r[3] for r in stored(store)] == ["A", "B", "C", "D"]


def test_metadata_compatibility(spark):
    old, new = (make_log(spark, [("a", "1", "A", b"", m)]) for m in (b"1", b"2"))
    check = append.all_of(append.basic, append.same_metadata)
    assert append.overlap(old, new).first()["compatible"] and not append.overlap(old, new, check).first()["compatible"]


def test_retries():
    calls = []

    def write(error, times):
        calls.append(1)
        if len(calls) <= times:
            raise error

    retrying(write, 3, 0)(OSError(), 2)
    assert len(calls) == 3
    calls.clear()
    with pytest.raises(OSError):
        retrying(write, 3, 0)(OSError(), 9)
    calls.clear()
    with pytest.raises(WrongExpectedVersion):
        retrying(write, 3, 0)(WrongExpectedVersion(1, 2), 9)
    assert len(calls) == 1


@pytest.mark.parametrize(
    "current, new, path",
    [
        ({"a": 1}, {"a": 1, "b": 2}, None),
        ({"a": 1, "b": None}, {"a": 1}, None),
        ({"a": 1, "b": 2}, {"a": 1}, "/b"),
        ({"a": [1, {"x": 1}]}, {"a": [1, {"x": 1, "y": 2}]}, None),
        ({"a": [1, 2]}, {"a": [1]}, "/a"),
        ({"a": {"b": [1, 2]}}, {"a": {"b": [1, 3]}}, "/a/b/1"),
        (1, True, "/"),
    ],
)
def test_json_compatibility(current, new, path):
    assert difference(current, new) == path


def test_json_predicate(spark):
    old, new = (make_log(spark, [("a", "1", "A", d), ("a", "2", "A", b"{}")]) for d in (b'{"a":1}', b'{"a": 1, "b":2}'))
    assert column(append.overlap(old, new, same_json), "compatible") == [True, True]
    assert column(append.overlap(new, old, same_json).orderBy("stream_id"), "compatible") == [False, True]


def test_legacy_tables(spark):
    table = spark.sql("SELECT 1L AS version, timestamp '2024-01-01 10:00:00' AS effective_timestamp, 'A' AS event_type, cast('x' AS binary) AS body")
    row = from_legacy(table).first()
    assert (row["position"], row["stream_category"], row["event_number"], bytes(row["metadata"])) == (1, "all", 0, b'{"effective_timestamp":"2024-01-01T10:00:00Z"}')
    assert from_legacy(table, first_number=1).first()["event_number"] == 1
    assert to_legacy(from_legacy(table)).collect() == table.collect()


# Shovel


def test_shovel(spark):
    log = make_log(spark, [("david", "tom", "A"), ("david", "tom", "B"), ("foo", "bar", "C")])
    got = shovel.shovel(log).orderBy("position").collect()
    assert [bytes(r["metadata"]).decode() for r in got] == ["", '{"shovel_position":"2"}', '{"shovel_position":"3"}']
    assert [r["expected_version"] for r in got] == [-1, -1, -1]
    assert shovel.resume_position(shovel.shovel(log)) == 3 and shovel.resume_position(log.limit(0)) is None
    with pytest.raises(ValueError):
        shovel.resume_position(log)


def test_shovel_chunks_and_runs(spark):
    log = make_log(spark, [("a", "1", "A")] * 3 + [("b", "1", "B"), ("a", "1", "C")])
    got = shovel.shovel(log, max_batch=2).orderBy("position").collect()
    assert [(r["run"], r["chunk"], r["checkpoint"], r["expected_version"]) for r in got] == [(1, 0, False, -1), (1, 0, True, -1), (1, 1, True, 1), (2, 0, True, -1), (3, 0, True, 2)]
    assert {r["stream_category"] for r in shovel.shovel(log, "out").collect()} == {"out"}


def test_stamping_keeps_fields(spark):
    texts = ['{"b": 1, "a": "é"}', "[1]", "not json", None, '{"shovel_position":"1"}']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "position long, m string")
    got = [json.loads(t) for t in column(df.select(shovel.stamped(F.col("m"), F.col("position")).alias("m")), "m")]
    assert got == [{"b": 1, "a": "é", "shovel_position": "0"}, *({"shovel_position": str(k)} for k in (1, 2, 3, 4))]


def test_copied_events_are_compatible(spark):
    log = make_log(spark, [("a", "1", "A", b"x", b'{"k":1}'), ("a", "1", "B")])
    copy = shovel.shovel(log, max_batch=1).select(log.columns)
    same = append.overlap(copy, shovel.shovel(log).select(log.columns), shovel.same_but_position)
    assert column(same.orderBy("position"), "compatible") == [True, True]


# Diff


def ev(*rows):
    """(timestamp, type, body) rows as a side of a comparison."""
    return [(k + 1, *r) for k, r in enumerate(rows)]


def compare(spark, a, b, **more):
    sides = [spark.createDataFrame(x, "position long, ts string, type string, body string") for x in (a, b)]
    return by(diff.diff(*sides, **more), "seq", "class", "a_position", "b_position")


def test_diff_classes(spark):
    a = ev(("1", "A", "x"), ("2", "B", "y"), ("3", "C", "z"), ("4", "D", "w"))
    b = ev(("1", "A", "x"), ("9", "B", "y"), ("3", "other", "z"), ("4", "D", "other"))
    assert compare(spark, a, b) == [("matching", 1, 1), ("similar", 2, 2), ("similar", 3, 3), ("similar", 4, 4)]


def test_diff_out_of_order(spark):
    a, b = ev(("2", "T2", "b2"), ("1", "T1", "b1")), ev(("1", "T1", "b1"), ("2", "T2", "b2"))
    assert compare(spark, a, b) == [("unmatched_b", None, 1), ("matching", 1, 2), ("unmatched_a", 2, None)]


def test_diff_ties_and_ends(spark):
    a, b = ev(("1", "A", "x"), ("3", "C", "z")), ev(("1", "B", "y"))
    assert compare(spark, a, b) == [("unmatched_a", 1, None), ("unmatched_b", None, 1), ("unmatched_a", 2, None)]
    assert compare(spark, a, []) == [("unmatched_a", 1, None), ("unmatched_a", 2, None)]
    assert compare(spark, [], []) == []


@pytest.mark.parametrize("seed, window", [(1, 3), (2, 5), (3, 100_000), (4, 2)])
def test_diff_equals_one_walk(spark, seed, window):
    rng = random.Random(seed)
    base = [(f"{t:03d}", rng.choice("ABC"), rng.choice("xyz")) for t in range(40)]
    change = lambda r: (r[0], rng.choice("ABC"), rng.choice("xyz"))
    other = [change(r) if rng.random() < 0.2 else r for r in base if rng.random() > 0.1]
    rows, i, j = diff.walk(base, other)
    want = [(c, None if x is None else x + 1, None if y is None else y + 1) for c, x, y in rows]
    want += [("unmatched_a", k + 1, None) for k in range(i, len(base))] + [("unmatched_b", None, k + 1) for k in range(j, len(other))]
    assert compare(spark, ev(*base), ev(*other), window=window) == want


@pytest.mark.parametrize("ts", ["", "late", "tied"])
def test_diff_from_many_starts(spark, ts):
    rng = random.Random(4)
    stamp = lambda t: "" if not ts else f"{t // 300:05d}" if ts == "tied" else f"{t - 40 * rng.randrange(3) + 100:05d}"
    base = [(stamp(t), f"T{t % 7}", f"{t % 11}") for t in range(1200)]
    other = [(r[0], r[1], "{}") if t % 10 == 3 else r for t, r in enumerate(base) if t % 97 != 5]
    for a, b in ((base, other), (other, base)):
        rows, i, j = diff.walk(a, b)
        want = [(c, None if x is None else x + 1, None if y is None else y + 1) for c, x, y in rows]
        want += [("unmatched_a", k + 1, None) for k in range(i, len(a))] + [("unmatched_b", None, k + 1) for k in range(j, len(b))]
        assert compare(spark, ev(*a), ev(*b), window=800) == want


def test_diff_queries_take_the_whole_log(spark):
    folder = "/root/testdata/sf0.01"
    a, b = ([tuple(r) for r in side.orderBy("position").collect()] for side in catalog._sides(spark, folder))
    assert len(a) == 10_000
    rows, i, j = diff.walk([r[1:] for r in a], [r[1:] for r in b])
    want = [(c, None if x is None else a[x][0], None if y is None else b[y][0]) for c, x, y in rows]
    want += [("unmatched_a", r[0], None) for r in a[i:]] + [("unmatched_b", None, r[0]) for r in b[j:]]
    assert by(catalog.queries()["diff_walk"](spark, folder), "seq", "class", "a_position", "b_position") == want


def test_diff_summary_and_samples(spark, tmp_path):
    sides = [spark.createDataFrame(x, "position long, ts string, type string, body string") for x in (ev(("1", "A", "x"), ("2", "A", "y"), ("3", "B", "z")), ev(("1", "A", "x"), ("2", "A", "y"), ("4", "Q", "q")))]
    compared = diff.diff(*sides)
    got = {(r["class"], r["side"], r["type"]): (r["n"], r["first_ts"], r["last_ts"]) for r in diff.summary(compared).collect()}
    assert got[("matching", "a", "A")] == (2, "1", "2") and got[("unmatched_b", "b", "Q")] == (1, "4", "4")
    assert diff.samples(compared, 1).where("class = 'matching'").count() == 1
    diff.write_samples(compared, str(tmp_path / "samples"), 1)
    assert spark.read.csv(str(tmp_path / "samples"), sep="\t", header=True).count() == 3


def test_forks(spark):
    body = b'{"oldStream":{"category":"all","id":"all"},"lastWrittenEventNumber":1,"x":0}'
    log = make_log(spark, [("all", "all", f"event{k}") for k in range(1, 5)] + [("all", "fork", diff.FORKED, body)] + [("all", "fork", f"fork{k}") for k in range(1, 4)])
    original, fork = diff.forked_pair(log, "all", "fork")
    assert by(original, "position", "event_type") == ["event3", "event4"] and by(fork, "position", "event_type") == ["fork1", "fork2", "fork3"]
    with pytest.raises(ValueError):
        diff.forked_pair(log, "all", "all")
    assert by(diff.diff_events(make_log(spark, [("a", "1", "A", b"d", effective("7")), ("a", "1", "A")])), "position", "ts") == ["7", ""]


# Batches


def test_batches(spark):
    log = make_log(spark, [("a", "1", f"T{k}") for k in range(5)])
    rows = batches.batch_statistics(batches.batched(log, 2)).orderBy("batch").collect()
    assert [(r["min_position"], r["max_position"], r["event_count"], r["last_event_type"]) for r in rows] == [(1, 2, 2, "T1"), (3, 4, 2, "T3"), (5, 5, 1, "T4")]
    complete = lambda last: sorted(column(batches.complete_batches(batches.batched(log, 2), 2, last), "batch"))
    assert complete(None) == [0, 1] and complete(5) == [0, 1, 2] and complete(4) == [0, 1]
    stale = keyed(spark, [(7, None), (6, None), (100, 94), (100, 93)], "live long, archived long").select(batches.is_stale(F.col("live"), F.col("archived"), 2).alias("s"))
    assert column(stale, "s") == [True, False, False, True]


def test_copy_goes_on_from_its_checkpoint(spark, store, tmp_path):
    log = make_log(spark, [("a", "1", "A", b"1"), ("a", "1", "B", b"2", b'{"k":1}'), ("b", "1", "C"), ("a", "1", "D")])
    first = log.where("position <= 2")
    assert shovel.copy_new(first, store, max_batch=2) == 2
    assert json.loads(column(store.log.orderBy("position"), "metadata")[-1]) == {"k": 1, "shovel_position": "2"}
    assert shovel.shovel_until_caught_up(lambda: log, store) == 2 and shovel.copy_new(log, store) == 0
    got = store.log.orderBy("position")
    assert column(got, "event_type") == ["A", "B", "C", "D"] and column(got, "event_number") == [0, 1, 0, 2]
    # A copy whose chunks are cut otherwise repeats them without harm; another event in its way is an error.
    again = LogStore(spark, str(tmp_path / "again"))
    assert again.write_numbered(log.where("position <= 2")) == 2
    assert again.write_numbered(shovel.shovel(log, max_batch=1), shovel.same_but_position) == 2
    with pytest.raises(WrongExpectedVersion):
        LogStore(spark, str(tmp_path / "other")).write_numbered(log.where("position >= 2"))
    with pytest.raises(IncompatibleNewEvent):
        again.write_numbered(log.withColumn("data", F.lit(b"x")))


@pytest.mark.parametrize("text, kept", [("", {}), ("[1]", {}), ("{}", {}), ("{ }", {}), ('{"a":"}"}', {"a": "}"}), ('{"shovel_position":"7","b":[1,{"c":2}]}', {"b": [1, {"c": 2}]}), ('{"a":1, "shovel_position" : "7" }', {"a": 1}), ("{broken", {}), (None, {})])
def test_stamps_without_python(spark, text, kept):
    df = spark.createDataFrame([(text, 42)], "m string, position long").select(shovel.stamped(F.col("m"), F.col("position")).alias("m"))
    assert json.loads(df.first()["m"]) == kept | {"shovel_position": "42"}
    assert "Python" not in df._jdf.queryExecution().toString()


def test_dead_writers_lock_is_taken_over(spark, tmp_path):
    short = LogStore(spark, str(tmp_path / "s"), lease_seconds=0.5)
    (tmp_path / "s").mkdir()
    (tmp_path / "s/_lock").touch()
    with pytest.raises(StoreLocked), short.locked(wait_seconds=0.1):
        pass
    time.sleep(0.6)
    short.write("a", "1", [("A", b"")])
    assert short.log.count() == 1 and not (tmp_path / "s/_lock").exists()


def test_appends_look_at_their_streams_only(spark):
    log = make_log(spark, [("a", "1", "A"), ("b", "2", "B")])
    new = spark.createDataFrame([(0, "b", "2")], "ord long, stream_category string, stream_id string")
    assert [tuple(r) for r in append.versions_of(log, new).collect()] == [("b", "2", 0)]


def test_legacy_writers(spark, tmp_path):
    old = LegacyStore(spark, str(tmp_path / "t"), now="2024-01-01 00:00:00")
    old.save([("A", b"1", b'{"effective_timestamp":"2020-01-01T00:00:00Z"}'), ("B", b"2")])
    old.save_auto_increment([("C", b"3")])
    assert column(old.page(), "version") == [1, 2, 3] and column(old.page(1, 1), "event_type") == ["B"]
    assert [t.year for t in column(old.page(), "effective_timestamp")] == [2020, 2024, 2024]
    with pytest.raises(WrongExpectedVersion):
        old.save([("D", b"4")], expected_version=2)
    with pytest.raises(ValueError):
        old.save_auto_increment([("D", b"4")], expected_version=3)
    assert old.save_idempotently([("C", b"3"), ("D", b"4")], expected_version=2) == 1
    assert old.save_idempotently([("C", b"3"), ("D", b"4")], expected_version=2) == 0
    with pytest.raises(IncompatibleNewEvent):
        old.save_idempotently([("X", b"3")], expected_version=2)
    with pytest.raises(WrongExpectedVersion):
        old.save_idempotently([("X", b"3")], expected_version=9)
    old.write("all", "all", [("E", b"5")], expected_version=3, metadata=False)
    for bad in (("x", "all", [("F", b"")]), ("all", "all", [("F", b"", b"m")])):
        with pytest.raises(ValueError):
            old.write(*bad, metadata=False)
    with pytest.raises(ValueError):
        old.read_stream("other", "1")
    assert column(old.read_stream("all", "all", 2), "event_type") == ["D", "E"]


def test_jdbc_table(spark, tmp_path):
    """The embedded database that comes with Spark, under other column names."""
    table = JdbcEvents(spark, f"jdbc:derby:{tmp_path}/db;create=true", "events", {"position": "pos", "timestamp": "written_at"}, {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    spark._jvm.java.lang.Class.forName("org.apache.derby.iapi.jdbc.AutoloadedDriver")
    table.create()
    new = LogStore(spark, str(tmp_path / "s")).events
    table.write(new("a", "1", [("A", b"1", b"m"), ("B", b"2")]), expected_version=-1)
    table.write(new("a", "2", [("C", b"3")]))
    table.write(new("a", "1", [("D", b"4")]), expected_version=1)
    with pytest.raises(WrongExpectedVersion):
        table.write(new("a", "1", [("E", b"")]), expected_version=0)
    assert by(table.log(2), "position", "position", "event_type", "event_number") == [(1, "A", 0), (2, "B", 1), (3, "C", 0), (4, "D", 2)]
    assert bytes(table.log().where("position = 1").first()["metadata"]) == b"m"
    assert column(table.page(1, 2), "event_type") == ["B", "C"]
    own = table.log().where("stream_category = 'a' and stream_id = '1' and position > 1")
    pushed = own._jdf.queryExecution().executedPlan().toString()
    assert column(own.orderBy("position"), "event_type") == ["B", "D"] and "EqualTo(STREAM_ID,1)" in pushed.replace("stream_id", "STREAM_ID")


def test_one_walk_for_several_listeners(spark):
    log = make_log(spark, [("a", "1", "A"), ("a", "1", "B")])
    seen = []
    diff.broadcast(diff.diff(diff.diff_events(log), diff.diff_events(log)), lambda c: seen.append(c.count()), lambda c: seen.append(diff.summary(c).count()))
    assert seen == [2, 4]

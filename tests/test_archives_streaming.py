import base64
import datetime as dt
import gzip
import lzma

import pytest

from tests.helpers import UTC, by, make_log
from tidelog.functions import codecs
from tidelog.operators.shovel import shovel
from tidelog.model import WrongExpectedVersion
from tidelog.sources import archives
from tidelog.sources.store import LogStore
from tidelog.streaming import health
from tidelog.streaming.subscription import Lifecycle, Subscription

GOLDEN = "gAAAAAgBEgsIuv7l8QUQlZrvOhoEdXNlciIkM0U0RTM3MUUtRTZBNC00MjlELUExM0MtOTIwQkZDQ0I3QTVDKAEyC1VzZXJDcmVhdGVkOhZ7Im5hbWUiOiJGcmVkIEJsb2dncyJ9Qhx7Imhvc3QiOiJ1c2VybWdtdC0wMDEucHJvZCJ9"


def test_golden_frame():
    data = base64.b64decode(GOLDEN)
    (e,) = codecs.decode_frames(data)
    assert e["timestamp"] == (int(dt.datetime(2020, 2, 4, 14, 27, 6, tzinfo=UTC).timestamp()), 123456789)
    assert (e["position"], e["stream_category"], e["event_number"], e["event_type"], e["data"], e["metadata"]) == (1, "user", 1, "UserCreated", b'{"name":"Fred Bloggs"}', b'{"host":"usermgmt-001.prod"}')
    assert codecs.encode_frame(e) == data
    with pytest.raises(ValueError):
        list(codecs.decode_frames(data[:-1]))


def event(**more):
    return {"position": 1, "timestamp": (0, 0), "stream_category": "a", "stream_id": "é🙂\0", "event_number": -1, "event_type": "T", "data": b"\xff", "metadata": b""} | more


def test_frames_and_cache_records_round_trip():
    events = [event(), event(position=1 << 40, timestamp=(-5, 999), data=b"x" * 300)]
    assert list(codecs.decode_frames(b"".join(map(codecs.encode_frame, events)))) == events
    cached = [event(position="p1", timestamp=-1), event(position="p2", timestamp=1 << 41)]
    data = b"".join(map(codecs.encode_cache_record, cached))
    assert list(codecs.decode_cache_records(data)) == cached and b"\xc0\x80" in data
    with pytest.raises(ValueError):
        list(codecs.decode_cache_records(data[:-1]))
    with pytest.raises(ValueError):
        codecs.modified_utf8("x" * 70_000)


def test_member_and_file_names():
    m = codecs.MEMBER.fullmatch("00000000.instrument.818e8eef-aeec-5062-b550-50c17c8d84fe.0.QuoteIdAssigned.data")
    assert (m["index"], m["category"], m["id"], m["number"], m["type"], m["kind"]) == ("00000000", "instrument", "818e8eef-aeec-5062-b550-50c17c8d84fe", "0", "QuoteIdAssigned", "data")
    odd = "a%b.c/d:e\né🙂"
    assert codecs.unescape(codecs.escape(odd)) == odd and not set("./:\n") & set(codecs.escape(odd))
    name = codecs.flat_name(255, "2024-01-01T00:00:00.123Z", "c.d", "i/1", 7, "T", suffix=".json")
    assert name.startswith("000000ff.2024-01-01T00:00:00.123Z.c%002ed.i%002f1.7.T.data")
    got = codecs.parse_flat_name(name)
    assert (got["timestamp"], got["stream_category"], got["stream_id"], got["event_number"], got["kind"]) == ("2024-01-01T00:00:00.123Z", "c.d", "i/1", 7, "data")
    with pytest.raises(ValueError):
        codecs.parse_flat_name("README.txt")


MEMBERS = [("00000000.a.1.0.T.data", b"d0", 0), ("00000000.a.1.0.T.metadata", b"m0", 0), ("00000001.a.1.1.T.data", b"d1", 0), ("00000002.b.x.y.0.U.data", b"", 0)]


def test_cpio_seek():
    data = codecs.encode_cpio(MEMBERS)
    assert [(e["position"], e["stream_id"], e["data"], e["metadata"]) for e in codecs.cpio_events(data)] == [("00000000.a.1.0.T", "1", b"d0", b"m0"), ("00000001.a.1.1.T", "1", b"d1", b""), ("00000002.b.x.y.0.U", "x.y", b"", b"")]
    assert [e["position"] for e in codecs.cpio_events(data, "00000001.a.1.1.T")] == ["00000002.b.x.y.0.U"]
    with pytest.raises(ValueError):
        list(codecs.decode_cpio(data[:150]))


def test_cpio_folder_prefers_xz(spark, tmp_path):
    data = codecs.encode_cpio(MEMBERS)
    (tmp_path / "x.cpio").write_bytes(b"broken")
    (tmp_path / "x.cpio.gz").write_bytes(b"broken")
    (tmp_path / "x.cpio.xz").write_bytes(lzma.compress(data))
    (tmp_path / "y.cpio.gz").write_bytes(gzip.compress(codecs.encode_cpio([("00000003.a.1.2.T.data", b"", 0)])))
    (tmp_path / "y.position.txt").write_text("3")
    assert by(archives.read_cpio(spark, str(tmp_path)), "position", "position") == ["00000000.a.1.0.T", "00000001.a.1.1.T", "00000002.b.x.y.0.U", "00000003.a.1.2.T"]
    assert archives.read_cpio(spark, str(tmp_path), "00000002.b.x.y.0.U").count() == 1


@pytest.fixture
def log(spark):
    return make_log(spark, [("a", "1", f"T{k}", f"d{k}".encode(), b"" if k % 2 else b"m") for k in range(5)])


def test_incremental_cpio_archive(spark, log, tmp_path):
    folder = str(tmp_path / "archive")
    with pytest.raises(ValueError):
        archives.archive_new_events(log, folder)
    assert archives.archive_new_events(log.where("position <= 2"), folder, create_initial=True) == 1
    assert archives.archive_boundary(spark, folder) == (2, 2)
    assert archives.archive_new_events(log, folder, per_file=2) == 2
    assert archives.archive_new_events(log, folder) == 0
    assert archives.archive_boundary(spark, folder) == (5, 5)
    got = by(archives.read_cpio(spark, folder), "position", "event_type", "event_number", "data", "metadata")
    assert [(t, n, bytes(d), bytes(m)) for t, n, d, m in got] == [(f"T{k}", k, f"d{k}".encode(), b"" if k % 2 else b"m") for k in range(5)]


def test_archive_then_live(spark, log, tmp_path):
    folder = str(tmp_path / "archive")
    archives.archive_new_events(log.where("position <= 3"), folder, create_initial=True, per_file=2)
    got = by(archives.read_archive_then_live(spark, folder, log), "event_number", "event_type", "place")
    assert [t for t, _ in got] == [f"T{k}" for k in range(5)]
    assert got[-1][1] == "00000002.a.1.2.T2:5"


def test_framed_archive(spark, log, tmp_path):
    folder = str(tmp_path)
    assert archives.max_archived_position(spark, folder, "s") is None and archives.last_framed_event(spark, folder, "s").count() == 0
    written = archives.write_framed(log, folder, "s", 2).orderBy("batch").collect()
    assert [(r["min_position"], r["max_position"], r["event_count"]) for r in written] == [(1, 2, 2), (3, 4, 2)]
    assert archives.max_archived_position(spark, folder, "s") == 4
    assert archives.max_archived_position(spark, folder, "s", dt.datetime(2000, 1, 1)) is None
    assert by(archives.read_framed(spark, folder, "s", 1), "position", "position", "event_type") == [(2, "T1"), (3, "T2"), (4, "T3")]
    assert by(archives.read_framed(spark, folder, "s", -1, max_position=3), "position", "position") == [1, 2]
    assert by(archives.last_framed_event(spark, folder, "s"), "position", "position") == [4]
    assert archives.write_framed(log, folder, "s", 2, last_position=5).count() == 1
    assert archives.read_framed(spark, folder, "s").count() == 5
    assert by(archives.read_framed(spark, folder, "s"), "position", "timestamp") == by(log, "position", "timestamp")


def test_cache_files(spark, log, tmp_path):
    for r in archives.cache_bytes(log, 2).collect():
        (tmp_path / r["name"]).write_bytes(r["content"])
    (tmp_path / "z.tmp").write_bytes(b"unfinished")
    got = by(archives.read_cache(spark, str(tmp_path)), "position", "position", "event_type", "timestamp")
    assert got == [(str(p), t, ts) for p, t, ts in by(log, "position", "position", "event_type", "timestamp")]
    assert archives.last_cached_position(spark, str(tmp_path)) == "5"


def test_flat_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / codecs.flat_name(k + 1, f"2024-01-01T00:00:0{k}.5Z" if k else "2024-01-01T00:00:00Z", "c", "i.1", k, "T", suffix=".json")).write_bytes(f"d{k}".encode())
    (tmp_path / codecs.flat_name(2, "2024-01-01T00:00:01.5Z", "c", "i.1", 1, "T", "metadata", ".json")).write_bytes(b"m1")
    (tmp_path / "README").write_text("no event")
    rows = archives.read_flat(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r["event_number"], r["stream_id"], bytes(r["data"]), bytes(r["metadata"])) for r in rows] == [(0, "i.1", b"d0", b""), (1, "i.1", b"d1", b"m1"), (2, "i.1", b"d2", b"")]
    assert archives.read_flat(spark, str(tmp_path), rows[0]["position"]).count() == 2


def test_cache_and_flat_writers(spark, log, tmp_path):
    written = archives.write_cache(log, str(tmp_path / "cache"), 2).collect()
    assert sorted(r["events"] for r in written) == [1, 2, 2] and not list((tmp_path / "cache").glob("*.tmp"))
    assert by(archives.read_cache(spark, str(tmp_path / "cache")), "position", "position", "event_type") == [(str(p), t) for p, t in by(log, "position", "position", "event_type")]
    folder = str(tmp_path / "flat")
    new = LogStore(spark, str(tmp_path / "s")).events
    assert archives.write_flat(new("c", "i.1", [("A", b"1", b"m"), ("B", b"2")]), folder, expected_version=-1, clock="2024-01-01T00:00:00.5Z") == 2
    assert archives.write_flat(new("c", "j", [("C", b"3")]), folder) == 1
    assert archives.write_flat(new("c", "i.1", [("D", b"")]), folder, expected_version=1) == 1
    with pytest.raises(WrongExpectedVersion):
        archives.write_flat(new("c", "i.1", [("E", b"")]), folder, expected_version=1)
    rows = archives.read_flat(spark, folder).orderBy("position").collect()
    assert [(int(r["position"][:8], 16), r["stream_id"], r["event_number"], r["event_type"], bytes(r["metadata"])) for r in rows] == [(1, "i.1", 0, "A", b"m"), (2, "i.1", 1, "B", b""), (3, "j", 0, "C", b""), (4, "i.1", 2, "D", b"")]


def test_flat_files_of_large_logs(spark, tmp_path, monkeypatch):
    """Names are listed by tasks, and no folder gets them all: past the first million positions each 65,536 have a folder."""
    (tmp_path / codecs.flat_name(0x10FFFE, "2024-01-01T00:00:00Z", "c", "i.1", 4, "T")).write_bytes(b"d0")
    (tmp_path / codecs.flat_name(0x10FFFE, "2024-01-01T00:00:00Z", "c", "i.1", 4, "T", "metadata")).write_bytes(b"m0")
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / codecs.flat_name(0x20FFFE, "2024-01-01T00:00:00Z", "c", "i.1", 9, "T")).write_bytes(b"no event of this folder")
    new = LogStore(spark, str(tmp_path / "s")).events
    batches = [new("c", "i.1", [("A", b"1", b"m"), ("B", b"2")]), new("c", "i.1", [("C", b"3")])]
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: pytest.fail("names went through the driver"))
    assert [archives.write_flat(b, str(tmp_path)) for b in batches] == [2, 1]
    rows = archives.read_flat(spark, str(tmp_path)).orderBy("position").collect()
    assert [(int(r["position"][:8], 16), r["event_number"], r["event_type"], bytes(r["data"]), bytes(r["metadata"])) for r in rows] == [
        (0x10FFFE, 4, "T", b"d0", b"m0"), (0x10FFFF, 5, "A", b"1", b"m"), (0x110000, 6, "B", b"2", b""), (0x110001, 7, "C", b"3", b"")]
    assert [len(list((tmp_path / p).iterdir())) for p in ("0010", "0011")] == [2, 2]
    assert [r["event_type"] for r in archives.read_flat(spark, str(tmp_path), rows[1]["position"]).orderBy("position").collect()] == ["B", "C"]


def test_only_chosen_files_are_opened(spark, log, tmp_path):
    """Damaged files outside the range don't matter, since nobody reads them."""
    folder = str(tmp_path / "framed")
    archives.write_framed(log, folder, "s", 1).collect()
    first = sorted((tmp_path / "framed/s").glob("*.gz"))[0]
    first.write_bytes(b"damaged")
    assert archives.read_framed(spark, folder, "s", after=1).count() == 4
    assert archives.last_framed_event(spark, folder, "s").first()["position"] == 5
    archives.write_cpio(log, str(tmp_path / "cpio"), per_file=1).collect()
    files = sorted((tmp_path / "cpio").rglob("*.cpio.gz"))
    end = archives.last_cpio_position(spark, str(tmp_path / "cpio"))
    rest = archives.read_cpio(spark, str(tmp_path / "cpio"), after=files[0].name.removesuffix(".cpio.gz"))
    assert rest.count() == 4
    files[0].write_bytes(b"damaged")
    assert archives.last_cpio_position(spark, str(tmp_path / "cpio")) == end


# Subscription


def test_subscription(spark, log, tmp_path):
    source, seen, lives = str(tmp_path / "in"), [], []
    log.where("position <= 3").coalesce(1).write.parquet(source)
    sub = Subscription(spark, "s", source, [lambda b: seen.extend(r["position"] for r in b.collect())], str(tmp_path / "cp"), start_position=1, decode=lambda b: b.where("event_type <> 'T1'"), on_lifecycle=lambda e, p: lives.append((e, p)), schema=log.schema)
    assert sub.catch_up() == 3 and seen == [3]
    log.where("position > 3").coalesce(1).write.mode("append").parquet(source)
    assert sub.catch_up() == 5 and seen == [3, 4, 5]
    assert lives == [(Lifecycle.INITIAL_CATCHUP_COMPLETED, 3), (Lifecycle.CAUGHT_UP, 5)]


def test_subscription_stops_at_a_failure_and_resumes(spark, log, tmp_path):
    source, seen, lives, broken = str(tmp_path / "in"), [], [], [True]
    log.coalesce(1).write.parquet(source)

    def handle(batch):
        if broken[0]:
            raise RuntimeError("handler failed")
        seen.extend(r["position"] for r in batch.collect())

    make = lambda: Subscription(spark, "f", source, [handle], str(tmp_path / "cp"), on_lifecycle=lambda e, p: lives.append(e), schema=log.schema)
    with pytest.raises(Exception, match="handler failed"):
        make().catch_up()
    assert seen == [] and lives == [Lifecycle.TERMINATED]
    broken[0] = False
    make().catch_up()
    assert seen == [1, 2, 3, 4, 5]


def test_subscription_goes_on_and_stops(spark, log, tmp_path):
    source, seen = str(tmp_path / "in"), []
    log.where("position <= 2").coalesce(1).write.parquet(source)
    query = Subscription(spark, "g", source, [lambda b: seen.extend(r["position"] for r in b.collect())], str(tmp_path / "cp"), schema=log.schema, run_frequency_seconds=0.1).start()
    query.processAllAvailable()
    log.where("position > 2").coalesce(1).write.mode("append").parquet(source)
    query.processAllAvailable()
    query.stop()
    assert seen == [1, 2, 3, 4, 5] and not query.isActive
    with pytest.raises(ValueError):
        Subscription(spark, "h", source, [], "x", staleness_seconds=(0.5, 10))


def test_waiting_for_a_subscription(spark, log, tmp_path):
    source, lives = str(tmp_path / "in"), []
    log.where("position <= 2").coalesce(1).write.parquet(source)
    sub = Subscription(spark, "w", source, [lambda b: b.count()], str(tmp_path / "cp"), on_lifecycle=lambda e, p: lives.append((e, p)), schema=log.schema, run_frequency_seconds=0.1)
    query = sub.start()
    assert sub.initial_catchup.result(60) == 2
    sub.await_position(2, 1)
    with pytest.raises(TimeoutError):
        sub.await_position(5, 0.2)
    log.where("position > 2").coalesce(1).write.mode("append").parquet(source)
    sub.await_position(5, 60)
    query.stop()
    assert lives == [(Lifecycle.INITIAL_CATCHUP_COMPLETED, 2), (Lifecycle.CAUGHT_UP, 5)]

    def fail(batch):
        raise RuntimeError("no")

    broken = Subscription(spark, "x", source, [fail], str(tmp_path / "cp2"), schema=log.schema, run_frequency_seconds=0.1)
    broken.start()
    with pytest.raises(RuntimeError):
        broken.initial_catchup.result(60)
    with pytest.raises(RuntimeError):
        broken.await_position(1, 60)


def test_archive_connection():
    assert health.archive_connection(lambda: 7) == (health.OK, "archived up to 7")
    assert health.archive_connection(lambda: None) == (health.OK, "empty archive")
    assert health.archive_connection(lambda: 1 / 0)[0] == health.CRITICAL


def test_health(spark, log):
    t = health.Threshold.ratio(1, 5)
    assert [t.status(x) for x in (1, 1.5, 5, 6)] == ["OK", "WARNING", "WARNING", "CRITICAL"]
    with pytest.raises(ValueError):
        health.Threshold(2, 1)
    assert health.poll_threshold(1) == health.Threshold(5, 30) and health.poll_threshold(60) == health.Threshold(300, 600)
    assert health.poll_status(None, t)[0] == "WARNING" and health.poll_status(9, t)[0] == "CRITICAL"
    status = lambda *a: health.subscription_status(*a, t, t)[0]
    assert [status(False, False, False, 0), status(True, False, False, 0), status(True, False, False, 9), status(True, True, False, 0), status(True, True, False, 2), status(True, True, True, 0)] == ["WARNING", "OK", "CRITICAL", "OK", "WARNING", "CRITICAL"]
    assert health.store_status(log) == ("OK", "last position 5") and health.store_status(spark.createDataFrame([], "x int"))[0] == "CRITICAL"
    assert health.archive_status(100, 93, 2)[0] == "WARNING" and health.archive_status(6, None, 2)[0] == "OK"
    assert shovel(log).count() == 5

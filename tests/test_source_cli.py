import pytest
from pyspark.sql import functions as F

from tests.helpers import by, column, make_log
from tidelog.operators.source import LogSource, Unsupported, merged, merged_in_order, stitched
from tidelog.operators.transform import containing_event_types
from tidelog.plans.cli import main
from tidelog.sources.store import LogStore


def test_sources(spark, tmp_path):
    source = LogSource.of_store(LogStore(spark, str(tmp_path / "s")))
    source.write("a", "1", [("A", b""), ("B", b"")])
    assert column(source.read_all(1), "event_type") == ["B"] and column(source.read_all_backwards(), "event_type") == ["B", "A"]
    assert column(source.read_categories("a"), "event_type") == ["A", "B"] and column(source.read_stream("a", "1", 0), "event_type") == ["B"]
    assert column(source.read_category_backwards("a"), "position") == [2, 1] and column(source.read_stream_backwards("a", "1", 1), "event_number") == [0]
    assert column(source.read_last_event(), "event_type") == ["B"] and source.status() == ("OK", "last position 2")
    derived = source.apply(containing_event_types("B"))
    assert column(derived.read_all(), "event_type") == ["B"]
    for call in (lambda: derived.read_categories("a"), lambda: derived.read_stream("a", "1"), lambda: derived.write("a", "1", [("C", b"")])):
        with pytest.raises(Unsupported):
            call()
    both = merged({"x": source, "y": source}, F.col("position"))
    assert by(both.log(), "merge_rank", "event_type") == ["A", "A", "B", "B"]
    position = both.codec.render((1, 2))
    assert column(both.read_all(position), "event_type") == ["B"] and column(both.read_last_event(), "event_type") == ["B"]
    assert column(merged_in_order({"x": source, "y": source}).read_all(), "event_type") == ["A", "B", "A", "B"]
    whole = stitched(source, source, 1)
    assert column(whole.read_all(), "event_type") == ["A", "B", "B"] and column(whole.read_categories("a"), "event_type") == ["A", "B", "B"]
    assert column(whole.read_all("1~~~1"), "event_type") == ["B", "B"] and column(whole.read_categories("a", after="2~~~2"), "event_type") == []
    assert column(whole.read_all_backwards(), "stitched")[0] == "2~~~2"
    for call in (lambda: whole.read_stream("a", "1"), lambda: whole.write("a", "1", [("C", b"")]), lambda: both.read_categories("a")):
        with pytest.raises(Unsupported):
            call()


def test_commands(spark, tmp_path):
    log = make_log(spark, [("a", "1", "A"), ("a", "1", "B")])
    for name in "ab":
        log.where(f"position <= {'ab'.index(name) + 1}").write.parquet(str(tmp_path / name))
    main(["diff-tables", str(tmp_path / "a"), str(tmp_path / "b"), "--output", str(tmp_path / "out")])
    got = spark.read.csv(str(tmp_path / "out/summary"), sep="\t", header=True)
    assert {(r["class"], r["n"]) for r in got.collect()} == {("matching", "1"), ("unmatched_b", "1")}
    main(["archive", str(tmp_path / "b"), str(tmp_path / "cpio"), "--create-initial"])
    assert (tmp_path / "cpio").exists()

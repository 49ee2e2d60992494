"""The stages of the pipeline, each on the rows of the one before."""

import pyarrow.parquet as pq
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.cases import frame, values
from tests.llm.test_ngram_join import plain

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    source = {d["doc_id"]: d for d in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    items = [i["text"] for i in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    columns, ids = docs.columns, set(source)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        got = [r.asDict() for r in docs.collect()]
        assert all(r == source[r["doc_id"]] for r in got)
        now = [r["doc_id"] for r in got]
        if k == 0:
            assert len(now) == len(set(now)) >= 0.97 * len(ids)
        if k == 1:
            want = {c for _, c in plain({i: source[i]["text"] for i in ids}).values()}
            assert sorted(now) == sorted(want)
        if k == 2:
            leaks = {i for i in ids if any(t in source[i]["text"] for t in items)}
            assert not leaks & set(now) and len(ids - leaks - set(now)) <= 0.01 * len(ids)
        if k == 3:
            assert all(now.count(i) <= 2 for i in set(now)) and set(now) <= ids
        ids = set(now)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    placed = sorted(map(tuple, corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()))
    base = 0
    for i, (doc_id, start, n, _) in zip(sorted(r["doc_id"] for r in got), placed, strict=True):
        assert (doc_id, start, n) == (i, base, len(tokenizer.encode(source[i]["text"], add_special_tokens=False).ids) + 1)
        base += n


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 100
    assert values(got) == values(corpus_pipeline.run(spark, SF))


def test_odd_rows(spark):
    docs = frame(spark)
    assert corpus_pipeline.one_per_group(spark, docs, SF).columns == docs.columns
    kept = values(corpus_pipeline.one_per_group(spark, docs, SF), "doc_id")
    assert kept == [(None,), (0,), (1,), (2,), (3,), (6,), (7,), (8,), (9,)]
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0

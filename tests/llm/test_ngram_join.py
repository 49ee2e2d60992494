"""The n-gram Jaccard join against brute force."""

import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import empty, frame, rows
from tidelog.llm import ngram_join
from tidelog.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def plain(texts, percent=75):
    """{doc_id: (n, component)} by comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    inverted = {}
    for i, s in sets.items():
        for x in s:
            inverted.setdefault(x, []).append(i)
    pairs = {(a, b) for own in inverted.values() for k, a in enumerate(own) for b in own[:k]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_tables(spark, folder):
    texts = {d["doc_id"]: d["text"] for d in pq.read_table(f"{folder}/documents.parquet").to_pylist()}
    assert result(ngram_join.join(spark.read.parquet(f"{folder}/documents.parquet"))) == plain(texts)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_families_of_edits(spark, seed):
    """Families whose pairs lie on both sides of the limit, with texts of many sizes and shared lines."""
    rng = random.Random(seed)
    line = " ".join(f"line{i}" for i in range(14))
    texts = {}
    for family in range(12):
        base = [f"f{family}w{rng.randrange(60)}" for _ in range(rng.choice([3, 6, 9, 20, 60, 150]))]
        for _ in range(rng.choice([2, 10, 40])):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(words) // 8)):
                k = rng.randrange(len(words))
                words[k : k + 1] = rng.choice([[], [f"x{rng.randrange(9)}"], [words[k], f"y{rng.randrange(1000)}"]])
            texts[len(texts)] = (line + "\n" if rng.random() < 0.4 else "") + " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert result(ngram_join.join(df)) == plain(texts)


@pytest.mark.parametrize("parts", [(1,), (32, 1), (2, 4, 1)])
def test_dense_families(spark, monkeypatch, parts):
    monkeypatch.setattr(ngram_join, "PARTS", parts)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = {i: " ".join(w if rng.random() > 0.03 else f"e{rng.randrange(5000)}" for w in base) for i in range(150)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert result(ngram_join.join(df)) == plain(texts)


def test_odd_rows(spark):
    df = frame(spark).where("doc_id is not null")
    got = result(ngram_join.join(df))
    want = plain({r[0]: r[1] for r in rows() if r[0] is not None})
    assert got == want and ngram_join.join(df).count() == len(rows()) - 1
    assert ngram_join.join(frame(spark)).count() == len(rows())
    assert ngram_join.join(empty(spark)).count() == 0


def test_null_ids_and_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(30))
    data = [(None, text), (5, text), (9, text + " end"), (None, None), (4, None), (None, "alone " + text[::-1])]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({n: F.lit(1) for n in ("k1", "row", "sid", "label", "component_id", "a.b")})
    kept = ngram_join.one_per_component(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted([(5, text), (0, ""), (4, ""), (0, "alone " + text[::-1])])
    assert {r["component_id"] for r in ngram_join.join(df).where("n_shingles > 0").collect()} == {5, None}


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 3)], "a long, b long")
    assert {r["node"]: r["label"] for r in components(edges).collect()} == {i: 0 for i in range(61)} | {100: 100, 101: 100}

"""Toxicity by the nearest labelled examples.

Documents are TF-IDF vectors over all terms of the labelled examples.  A term's inverse document
frequency is counted over all documents and multiplied by the square of its relevance frequency,
log2(2 + toxic examples with it / other examples with it), so that terms which go with the label
weigh more; no term is left out.  The examples lie in an inverted index cut into blocks, with the
largest weight of widespread terms in each block.  Query weight times block maximum bounds the
cosine of every example in a block; the blocks of the highest bounds are scored, and then those
whose bound reaches the k-th best cosine.  The result is exact: all examples whose cosine is at
least the k-th best, ties included.  Their votes, weighted by similarity, give a raw score,
which is calibrated by the same search over the examples, each without itself.

The classifier (terms, examples, calibration) is fitted on at most ``sample_rows`` labelled rows
with at most ``sample_postings`` distinct words in all: rows are taken by a hash of their id while
they fit.  This bounds the index that is broadcast.

Cases: a null or empty text, or one without a known term, gets the rate of such examples, or of
all where there are none; texts of any length are read whole; several labels of a doc_id count as
toxic if one is; equal texts are one example, toxic if one copy is, and get equal scores; ties at
the k-th cosine all vote, and no id or order of rows enters a score; without any labelled row
every score is 0; an empty table gives an empty result; extra columns, whatever their names, are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from hashlib import blake2b
from zlib import compress, decompress

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.textbytes import Words, slices, strings

SAMPLE_ROWS = 16_384
SAMPLE_POSTINGS = 6_000_000
BLOCK = 64
NEIGHBOURS = 25
FIRST_BLOCKS = 8
BATCH = 256
#: Terms in this share of the examples have columns.
OFTEN = 0.1
Vector = tuple[np.ndarray, np.ndarray]


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def term_counts(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash of a term, count) of the terms of each text, by row and hash."""
    words = Words.of(texts, fold=True).trim()
    terms, code = np.unique(words.hashes, return_inverse=True)
    rows = np.repeat(np.arange(len(texts)), words.counts)
    pairs, counts = np.unique(rows * max(1, len(terms)) + code, return_counts=True)
    return pairs // max(1, len(terms)), terms[pairs % max(1, len(terms))], counts


class Vocabulary:
    """Sorted term hashes, with a table of where those with the same first bits start."""

    BITS = 19

    def __init__(self, terms: np.ndarray):
        head = (terms >> np.uint64(64 - self.BITS)).astype(np.int64)
        self.terms, self.size = np.append(terms, np.uint64(2**64 - 1)), len(terms)
        self.start = np.searchsorted(head, np.arange(1 << self.BITS))
        self.depth = int(np.bincount(head, minlength=1).max())

    def find(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place in the vocabulary, count) of the known terms of each text, in order."""
        words = Words.of(texts, fold=True).trim()
        place = self.start[(words.hashes >> np.uint64(64 - self.BITS)).astype(np.int64)]
        for _ in range(self.depth):
            place += self.terms[place] < words.hashes
        rows = np.repeat(np.arange(len(texts)), words.counts)
        hit = (self.terms[place] == words.hashes) & (place < self.size)
        pairs, counts = np.unique(rows[hit] * max(1, self.size) + place[hit], return_counts=True)
        return pairs // max(1, self.size), pairs % max(1, self.size), counts


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers from each start on, ``lengths`` of them, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Index:
    """Labelled example vectors in blocks.

    A term of few examples has a posting list, whose products are summed as they are.  A term of
    many has a column, and its maximum in each block bounds what it adds there, so that columns
    are read only for blocks that may hold a near example.  Examples with the same widespread
    terms, of one language say, lie together, so that blocks differ in their maxima.
    """

    def __init__(self, factor: np.ndarray, labels: np.ndarray, examples: list[Vector]):
        self.factor = factor
        sizes = np.array([len(t) for t, _ in examples], np.int64)
        term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in examples)])
        spread = np.bincount(term, minlength=len(factor))
        # Blocks by the three most widespread terms of each example, then by its heaviest one.
        weighted = [self.weigh(t, c) for t, c in examples]
        keys = [(*t[np.argsort(-spread[t], kind="stable")[:3]].tolist(), int(t[np.argmax(w)])) if len(t) else () for (t, _), w in zip(examples, weighted)]
        self.order = np.array(sorted(range(len(examples)), key=keys.__getitem__), np.int64)
        self.labels = np.asarray(labels, float)[self.order]
        self.place = np.argsort(self.order)
        blocks = -(-len(examples) // BLOCK)
        example, weight = np.repeat(self.place, sizes), np.concatenate([np.zeros(0), *weighted])
        often = np.flatnonzero(spread >= max(2.0, OFTEN * len(examples)))
        self.column = np.full(len(factor), -1, np.int32)
        self.column[often] = np.arange(len(often))
        wide = self.column[term] >= 0
        self.columns = np.zeros((blocks * BLOCK, len(often)))  # the last rows may stand for no example
        self.columns[example[wide], self.column[term[wide]]] = weight[wide]
        self.peak = self.columns.reshape(blocks, BLOCK, len(often)).max(axis=1).T.copy()
        by = np.lexsort((example[~wide], term[~wide]))
        self.example, self.weight = example[~wide][by].astype(np.int32), weight[~wide][by]
        self.entry = np.concatenate([[0], np.cumsum(np.bincount(term[~wide], minlength=len(factor)))])

    def weigh(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.factor[terms]
        return w / np.sqrt((w * w).sum()) if len(w) else w

    def nearest(self, queries: list[Vector], k: int, skip: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the cosines (9 decimals) and examples: all above 0 that are at least the k-th best, ties included.

        Examples are numbered as given; each query's own number in ``skip`` is left out.
        """
        parts = range(0, len(queries), BATCH)
        return [x for a in parts for x in self._nearest(queries[a : a + BATCH], k, skip and skip[a : a + BATCH])]

    def _nearest(self, queries: list[Vector], k: int, skip: list[int] | None) -> list[tuple[np.ndarray, np.ndarray]]:
        n, m = len(self.columns), len(queries)
        row = np.repeat(np.arange(m), [len(t) for t, _ in queries])
        terms, weight = np.concatenate([t for t, _ in queries]), np.concatenate([self.weigh(*q) for q in queries])
        column = self.column[terms]
        wide = column >= 0
        dense = np.zeros((m, self.columns.shape[1]))
        dense[row[wide], column[wide]] = weight[wide]
        scores = np.empty((m, n))
        bounds = np.searchsorted(row[~wide], np.arange(m + 1))
        terms, weight = terms[~wide], weight[~wide]
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):  # a row at a time stays in the processor's cache
            number = self.entry[terms[a:b] + 1] - self.entry[terms[a:b]]
            at = ranges(self.entry[terms[a:b]], number)
            scores[i] = np.bincount(self.example[at], np.repeat(weight[a:b], number) * self.weight[at], n)
        scores = scores.reshape(m, -1, BLOCK)
        if skip is not None:
            scores.reshape(m, n)[np.arange(m), self.place[skip]] = -2  # and a cosine is at most 1
        # No example of a block is above its limit.
        limit = scores.max(axis=2) + dense @ self.peak + 1e-8
        best = np.argpartition(-limit, min(FIRST_BLOCKS, limit.shape[1] - 1), axis=1)[:, :FIRST_BLOCKS]
        first = np.zeros(limit.shape, bool)
        np.put_along_axis(first, best, True, axis=1)
        self._add(scores, dense, first)
        seen = np.take_along_axis(scores, best[:, :, None], axis=1).reshape(m, -1)
        least = np.maximum(np.partition(seen, -k, axis=1)[:, -k] if seen.shape[1] > k else np.zeros(m), 0) - 2e-8
        self._add(scores, dense, (limit >= least[:, None]) & ~first)
        # What is left out of a block that wasn't scored keeps it below its limit, and so below ``least``.
        rows, found = np.nonzero(scores.reshape(m, n) >= np.maximum(least, 1e-10)[:, None])
        cosines = np.round(scores.reshape(m, n)[rows, found], 9)
        out = []
        for a, b in zip(*(np.searchsorted(rows, np.arange(m), side) for side in ("left", "right"))):
            own, place = cosines[a:b], found[a:b]
            keep = (own > 0) & (own >= (np.partition(own, -k)[-k] if len(own) > k else 0))
            own, place = own[keep], place[keep]
            order = np.lexsort((self.labels[place], -own))
            out.append((own[order], self.order[place[order]]))
        return out

    def _add(self, scores: np.ndarray, dense: np.ndarray, chosen: np.ndarray) -> None:
        """Adds what the columns give to the scores of the chosen blocks of each query."""
        for block in np.flatnonzero(chosen.any(axis=0)):
            own = np.flatnonzero(chosen[:, block])
            scores[own, block] += dense[own] @ self.columns[block * BLOCK : (block + 1) * BLOCK].T

    def vote(self, cosines: np.ndarray, examples: np.ndarray, rate: float) -> float:
        """Similarity-weighted share of toxic examples, with one vote of weight 0.1 for the overall rate."""
        weights = cosines * cosines
        return round(float(((weights * self.labels[self.place[examples]]).sum() + 0.1 * rate) / (weights.sum() + 0.1)), 9)


class Calibration:
    """Isotonic regression of the labels on the votes (pool adjacent violators)."""

    def __init__(self, votes: np.ndarray, labels: np.ndarray, rate: float):
        order = np.lexsort((labels, votes))
        pools: list[list[float]] = []
        for v, y in zip(votes[order], labels[order]):
            pools.append([v, v, float(y), 1.0])
            while len(pools) > 1 and (pools[-2][1] == pools[-1][0] or pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]):
                low, high = pools[-2], pools.pop()
                pools[-1] = [low[0], high[1], low[2] + high[2], low[3] + high[3]]
        self.votes = np.array([v for p in pools for v in (p[0], p[1])] or [0.0, 1.0])
        self.rates = np.array([(p[2] + rate) / (p[3] + 1) for p in pools for _ in range(2)] or [0.0, 1.0])

    def score(self, vote: float) -> float:
        return float(np.interp(vote, self.votes, self.rates))


class Model:
    """The vocabulary, the weight of each of its terms, and the examples: flat terms and counts with bounds.

    The index is built where it is used; only the examples travel, compressed.
    """

    def __init__(self, vocabulary: np.ndarray, factor: np.ndarray, ids: np.ndarray, labels: np.ndarray, bounds: np.ndarray, terms: np.ndarray, counts: np.ndarray):
        self.vocabulary, self.factor, self.ids, self.labels = vocabulary, factor, ids, np.asarray(labels, float)
        self.bounds, self.terms, self.counts = bounds, terms.astype(np.int32, copy=False), counts.astype(np.int32, copy=False)
        self.rate = float(self.labels.mean())
        bare = np.diff(bounds) == 0
        self.rate_bare = float((self.labels[bare].sum() + self.rate) / (bare.sum() + 1))

    def __getstate__(self) -> tuple:
        packed = [(compress(x.tobytes(), 1), x.dtype.str) for x in (np.diff(self.vocabulary, prepend=np.uint64(0)), self.factor, self.ids, self.labels, self.bounds, np.diff(self.terms, prepend=0).astype(np.int32), self.counts)]
        return tuple(packed)

    def __setstate__(self, state: tuple) -> None:
        vocabulary, factor, ids, labels, bounds, terms, counts = (np.frombuffer(decompress(x), kind) for x, kind in state)
        self.__init__(np.cumsum(vocabulary, dtype=np.uint64), factor, ids, labels, bounds, np.cumsum(terms, dtype=np.int32), counts)

    def example(self, i: int) -> Vector:
        own = slice(self.bounds[i], self.bounds[i + 1])
        return self.terms[own].astype(np.int64), self.counts[own]

    @cached_property
    def index(self) -> Index:
        return Index(self.factor, self.labels, [self.example(i) for i in range(len(self.labels))])

    def raw(self, queries: list[Vector], skip: list[int] | None = None) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """The vote on each query, and the cosines and numbers of its nearest examples."""
        return [(self.index.vote(*near, self.rate), *near) for near in self.index.nearest(queries, NEIGHBOURS, skip)]


def relevance(toxic: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The square of the relevance frequency of terms in so many toxic and other examples."""
    return np.log2(2 + toxic / np.maximum(1, other)) ** 2


def build(vocabulary: np.ndarray, frequency: np.ndarray, documents: int, ids: np.ndarray, labels: np.ndarray, examples: list[Vector]) -> Model:
    """The model of example vectors over ``vocabulary``, whose terms ``frequency`` of all documents hold."""
    labels, sizes = np.asarray(labels, float), [len(t) for t, _ in examples]
    terms, counts = (np.concatenate([np.zeros(0, np.int32), *x]).astype(np.int32) for x in zip(*examples))
    toxic = np.bincount(terms, np.repeat(labels, sizes), len(vocabulary))
    factor = (np.log((documents + 1) / (frequency + 1)) + 1) * relevance(toxic, np.bincount(terms, minlength=len(vocabulary)) - toxic)
    return Model(vocabulary, factor, ids, labels, np.concatenate([[0], np.cumsum(sizes)]), terms, counts)


def _examples(sample: DataFrame) -> list:
    """doc_id, toxic, and the terms and counts of each example, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column("text"))
            for low, high in slices(texts):
                rows, terms, counts = term_counts(texts.slice(low, high - low))
                bounds = np.searchsorted(rows, np.arange(high - low + 1))
                packed = [[x[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])] for x in (terms, counts.astype(np.int32))]
                yield pa.record_batch([batch.column("doc_id").slice(low, high - low), batch.column("toxic").slice(low, high - low), *(pa.array(p, pa.binary()) for p in packed)], ["doc_id", "toxic", "terms", "counts"])

    return sample.mapInArrow(run, "doc_id long, toxic int, terms binary, counts binary").collect()


def _document_counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """Over all documents: how many hold each term, and how many there are."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, n = Vocabulary(shared.value), 0
        total = np.zeros(vocabulary.size, np.int64)
        for batch in batches:
            texts = strings(batch.column("text"))
            n += len(texts)
            for low, high in slices(texts):
                _, terms, _ = vocabulary.find(texts.slice(low, high - low))
                total += np.bincount(terms, minlength=len(total))
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(held, -1)), pa.array(np.append(total[held], n))], ["term", "n"])

    found = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = found["term"].to_numpy(), found["n"].to_numpy()
    out = np.zeros(len(vocabulary), np.int64)
    out[term[term >= 0]] = n[term >= 0]
    return out, int(n[term < 0].sum())


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` labelled rows whose remainder isn't 2; of equal texts one."""
    picked = (
        labels.where("doc_id is not null and toxic is not null")
        .where(remainder(F.col("doc_id")) != 2)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    sample = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    return sample.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")).select("doc_id", "toxic", "text")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_postings: int = SAMPLE_POSTINGS) -> tuple[Broadcast, Calibration] | None:
    """The classifier from the labelled rows whose remainder isn't 2: the model, on all executors, and its calibration.

    The driver holds the terms of the sample: twelve bytes for each of ``sample_postings``.
    """
    examples, held = [], 0
    for r in sorted(_examples(_sample(docs, labels, sample_rows)), key=lambda r: blake2b(str(r["doc_id"]).encode()).digest()):
        if held + len(r["terms"]) // 8 <= sample_postings:
            held += len(r["terms"]) // 8
            examples.append(r)
    if not examples:
        return None
    hashes = [np.frombuffer(r["terms"], np.uint64) for r in examples]
    vocabulary = np.unique(np.concatenate(hashes))
    vectors = [(np.searchsorted(vocabulary, h).astype(np.int32), np.frombuffer(r["counts"], np.int32)) for h, r in zip(hashes, examples)]
    model = build(vocabulary, *_document_counts(docs, vocabulary), np.array([r["doc_id"] for r in examples]), np.array([r["toxic"] for r in examples]), vectors)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return shared, _calibrate(docs.sparkSession, shared, len(examples), model.rate)


def _calibrate(spark: SparkSession, shared: Broadcast, examples: int, rate: float) -> Calibration:
    """From the votes of all examples with terms, each without itself, searched in parallel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [i for i in batch.column("id").to_pylist() if model.bounds[i] < model.bounds[i + 1]]
            votes = [vote for vote, *_ in model.raw([model.example(i) for i in found], found)]
            yield pa.record_batch([pa.array(votes, pa.float64()), pa.array(model.labels[found] if found else [], pa.float64())], ["vote", "toxic"])

    found = spark.range(0, examples, 1, spark.sparkContext.defaultParallelism).mapInArrow(run, "vote double, toxic double").toArrow()
    return Calibration(found["vote"].to_numpy(), found["toxic"].to_numpy(), rate)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS, sample_postings: int = SAMPLE_POSTINGS) -> DataFrame:
    """doc_id, held_out, score, predicted and the three nearest examples of every row of ``docs``."""
    schema = "doc_id long, score double, evidence array<long>, similarity array<double>"
    fitted = fit(docs, labels, sample_rows, sample_postings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, calibration, seen = (fitted[0].value, fitted[1], {}) if fitted else (None, None, {})
        vocabulary = Vocabulary(model.vocabulary) if fitted else None
        for batch in batches:
            texts = strings(batch.column("text"))
            out: list = [(0.0 if model is None else model.rate_bare, [], [])] * len(texts)
            for low, high in slices(texts) if model is not None else ():
                rows, terms, counts = vocabulary.find(texts.slice(low, high - low))
                bounds = np.flatnonzero(np.diff(rows, prepend=-1, append=-1))
                if len(seen) > 50_000:
                    seen.clear()
                keys = [blake2b(terms[a:b].tobytes() + counts[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:])]
                new = {key: (terms[a:b], counts[a:b]) for key, a, b in zip(keys, bounds[:-1], bounds[1:]) if key not in seen}
                for key, (vote, cosines, examples) in zip(new, model.raw(list(new.values()))):
                    best = sorted(zip((-cosines).tolist(), model.ids[examples].tolist()))[:3]
                    seen[key] = (calibration.score(vote), [i for _, i in best], [-c for c, _ in best])
                for a, key in zip(bounds, keys):
                    out[low + rows[a]] = seen[key]
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pa.list_(pa.float64()))], ["doc_id", "score", "evidence", "similarity"])

    scored = docs.select("doc_id", "text").mapInArrow(run, schema)
    held_out = F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence", "similarity")

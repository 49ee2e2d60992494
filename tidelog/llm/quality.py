"""Quality rules: measures of one document, and line frequency across the documents of a host.

Normalised lines (lower case, single blanks) are hashed, and for each host the distinct documents
that hold a line are counted.  Lines above the limits are removed; a document that loses too much
is rejected.  Documents are told apart by id, host and text; with ``per="texts"`` copies of a text
count once, so that a copied article isn't mistaken for boilerplate.

Cases: a null or empty text has no words and fails the base rule; a null host is a host of its
own; texts and lines of any length count whole; repeated rows (of equal id, host and text) count
once and get equal answers; ties play no part, since limits are compared with counts; an empty
table gives an empty result; extra columns, whatever their names, are ignored by :func:`judge`
and stay in :func:`clean`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.shared import cut
from tidelog.llm.textbytes import Words, mix, raw, slices, strings, sums

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows that stand in the text twice or more, the first included."""
    windows = Counter(zip(*(words[k:] for k in range(width))))
    end = total = 0
    for i in range(len(words) - width + 1):
        if windows[tuple(words[i : i + width])] > 1:
            total += i + width - max(i, end)
            end = i + width
    return total


def _measures(texts: pa.LargeStringArray) -> list[np.ndarray]:
    words = Words.of(texts)
    dup = np.zeros(len(texts), np.int64)
    lines = pc.split_pattern(texts, "\n")
    flat, row = lines.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(lines).to_numpy())
    full = Words.of(strings(flat)).counts > 0
    codes = flat.dictionary_encode().indices.to_numpy()[full].astype(np.int64)
    row = row[full]
    _, first = np.unique(row * (len(flat) + 1) + codes, return_index=True)
    np.add.at(dup, row, 1)
    np.subtract.at(dup, row[first], 1)

    repeats = np.zeros(len(texts), np.int64)
    hashes, offsets = words.windows(5)
    for i in range(len(texts)):
        own = np.sort(hashes[offsets[i] : offsets[i + 1]])
        if len(own) > 1 and (own[1:] == own[:-1]).any():  # exact count only where a hash repeats
            low, high = words.first[i], words.first[i + 1]
            data = words.data.tobytes() if len(texts) == 1 else words.data[words.offsets[i] : words.offsets[i + 1]].tobytes()
            base = words.offsets[i]
            repeats[i] = repeated_words([data[a - base : b - base] for a, b in zip(words.starts[low:high], words.ends[low:high])])
    data, offsets = raw(texts)
    return [words.counts, words.characters(), sums(_SYMBOL[data], offsets), dup, repeats]


def line_hashes(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, hash and number of words of each line with a word, in order, and all lines as lists."""
    lines = pc.split_pattern(texts, "\n")
    flat, row = lines.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(lines).to_numpy())
    words = Words.of(strings(pc.utf8_lower(flat)))
    counts, first = words.counts, words.first
    place = np.arange(len(words.starts)) - np.repeat(first[:-1], counts)
    total = np.zeros(len(place) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(words.hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), out=total[1:])
        hashes = mix(total[first[1:]] - total[first[:-1]] + counts.astype(np.uint64))
    full = counts > 0
    return row[full], hashes[full], counts[full], lines


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the column ``text`` of each batch by the measures and the distinct lines with their words."""
    names = [x.split()[0] for x in MEASURES.split(", ")]
    for batch in batches:
        texts = strings(batch.column("text"))
        kept = [n for n in batch.schema.names if n != "text"]
        for low, high in slices(texts):
            part = texts.slice(low, high - low)
            row, hashes, words, _ = line_hashes(part)
            order = np.lexsort((hashes, row))
            row, hashes, words = row[order], hashes[order], words[order]
            fresh = np.ones(len(row), bool)
            fresh[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
            words = np.add.reduceat(words, np.flatnonzero(fresh)) if len(words) else words
            bounds = pa.array(np.searchsorted(row[fresh], np.arange(high - low + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(hashes[fresh].view(np.int64))), pa.ListArray.from_arrays(bounds, pa.array(words, pa.int64()))]
            own = [batch.column(n).slice(low, high - low) for n in kept]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(m, pa.int64()) for m in _measures(part)), *lists], [*kept, *names, "lines", "line_words"])


def _keys(*columns: str) -> list[Column]:
    """Two hashes of the columns that tell null from any value."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(7), *parts).alias("k2")]


def _rows(docs: DataFrame, host: str, per: str, *more: Column) -> DataFrame:
    rows = docs.select("doc_id", F.col(f"`{host}`").cast("string").alias("host"), F.col("text").cast("string").alias("text"), *more)
    keys = _keys("host", "text") if per == "texts" else _keys("doc_id", "host", "text")
    return rows.select("doc_id", *keys, F.xxhash64(F.col("host").isNull(), "host").alias("h"), "text", *(["row"] if more else []))


def described(docs: DataFrame, host: str = "source", per: str = "documents") -> DataFrame:
    """doc_id, keys, host hash, measures and lines of every row: one pass over the texts, written to the shared folder."""
    rows = _rows(docs, host, per)
    schema = rows.drop("text").schema
    for field in MEASURES.split(", "):
        schema = schema.add(field.split()[0], "long")
    return cut(rows.mapInArrow(_described, schema.add("lines", T.ArrayType(T.LongType())).add("line_words", T.ArrayType(T.LongType()))), "quality-lines")


def removed_lines(rows: DataFrame, min_docs: int = 20, share: float = 0.02, max_docs: int = 5000) -> DataFrame:
    """k1, k2, lost (words), lost_lines and ``removed`` (hashes of lines) of documents that lose any, from :func:`described`.

    A line goes if more than ``min_docs`` distinct documents of its host hold it and these are more
    than ``share`` of the host's documents, or more than ``max_docs``.  Counts are summed before each
    shuffle; lines that stay never leave the tasks that read them unless the removed ones are too many
    to broadcast.
    """
    distinct = rows.select("k1", "k2", "h", "lines", "line_words").dropDuplicates(["k1", "k2"])
    hosts = distinct.groupBy("h").agg(F.count("*").alias("host_docs"))
    counts = distinct.select("h", F.explode("lines").alias("line")).groupBy("h", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > min_docs)
    common = counts.join(hosts, "h").where((F.col("docs") > share * F.col("host_docs")) | (F.col("docs") > max_docs)).select("h", "line")
    lines = distinct.select("k1", "k2", "h", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("k1", "k2", "h", F.col("x.lines").alias("line"), F.col("x.line_words").alias("n"))
    lost = lines.join(common, ["h", "line"]).groupBy("k1", "k2")
    return lost.agg(F.sum("n").alias("lost"), F.count("*").alias("lost_lines"), F.collect_list("line").alias("removed"))


def _verdicts(rows: DataFrame, lost: DataFrame, max_loss: float, min_words: int) -> DataFrame:
    lost_words = F.coalesce(F.col("lost"), F.lit(0)).cast("long")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = (lost_words > max_loss * F.col("n_words")) | (F.col("n_words") - lost_words < min_words)
    named = [x.split()[0] for x in MEASURES.split(", ")]
    return rows.drop("lines", "line_words").join(lost, ["k1", "k2"], "left").select(
        "doc_id",
        *named,
        failed.alias("base_failed"),
        (~failed & ~depleted).alias("kept"),
        lost_words.alias("n_removed_words"),
        F.coalesce(F.col("lost_lines"), F.lit(0)).cast("long").alias("n_removed_lines"),
        "k1",
        "k2",
        "removed",
    )


def judge(docs: DataFrame, host: str = "source", per: str = "documents", min_docs: int = 20, share: float = 0.02, max_docs: int = 5000, max_loss: float = 0.5, min_words: int = 10) -> DataFrame:
    """Measures and verdict of every row of ``docs`` (doc_id, text, ``host``).

    A document is rejected if over ``max_loss`` of its words stand in removed lines (see
    :func:`removed_lines`), or if fewer than ``min_words`` stay.
    """
    rows = described(docs, host, per)
    return _verdicts(rows, removed_lines(rows, min_docs, share, max_docs), max_loss, min_words).drop("k1", "k2", "removed")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines of the column ``removed``."""
    for batch in batches:
        texts, out = strings(batch.column("text")), []
        for low, high in slices(texts):
            row, hashes, _, lines = line_hashes(texts.slice(low, high - low))
            spans = np.searchsorted(row, np.arange(high - low + 1))
            for k, gone in enumerate(batch.column("removed").slice(low, high - low).to_pylist()):
                own = lines[k].as_py()
                if gone:
                    left = iter(~np.isin(hashes[spans[k] : spans[k + 1]].view(np.int64), gone))
                    own = [x for x in own if not x.strip(" \t\n\v\f\r") or next(left)]
                out.append("\n".join(own))
        kept = [n for n in batch.schema.names if n not in ("text", "removed")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(out, pa.string())], [*kept, "cleaned"])


def clean(docs: DataFrame, host: str = "source", per: str = "documents", min_docs: int = 20, share: float = 0.02, max_docs: int = 5000, max_loss: float = 0.5, min_words: int = 10) -> DataFrame:
    """The kept rows of ``docs``, with all their columns, and their texts without the removed lines."""
    rows = described(docs, host, per)
    verdicts = _verdicts(rows, removed_lines(rows, min_docs, share, max_docs), max_loss, min_words)
    kept = verdicts.where("kept").select("k1", "k2", "removed").dropDuplicates(["k1", "k2"])
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    joined = _rows(docs, host, per, row).join(kept, ["k1", "k2"]).select("row", "text", "removed")
    done = joined.mapInArrow(_without, joined.select("row").schema.add("cleaned", "string"))
    return done.select(F.col("row").withField("text", F.col("cleaned")).alias("row")).select("row.*")

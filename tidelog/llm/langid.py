"""Language identification by Bayesian evidence fusion.

The posterior of a language is proportional to the product of

* the likelihood of the text under a byte-trigram model of the language, tempered because
  neighbouring trigrams aren't independent;
* the probability that a text of the language declares what this one declares;
* the prior of the host, smoothed towards its address suffix, which is smoothed towards the
  whole corpus.

Models are fitted on a bounded sample of rows of each declared language: ``rows_per_language``, by a
hash of their id.  A language gets a model if ``least_rows`` rows of the corpus declare it, however
small its share, and is among the ``most_languages`` that most rows declare.  Declarations and priors
are counted over all rows by grouped aggregation of the text's own best language.  A flat model
stands for "no language"; a row is kept if a language beats it and is likely enough.

Cases: a null or empty text has no evidence of its own and is rejected; a null declaration,
suffix or host is a value like others for counting; texts of any length are read whole; of two
languages with equal scores the first by name wins; equal rows give equal rows; a corpus without
declared languages or an empty table rejects all rows; extra columns, whatever their names, are
ignored, or stay in the struct ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.shared import cut, small_batches
from tidelog.llm.textbytes import raw, slices, strings

BUCKETS = 1 << 15
ROWS_PER_LANGUAGE = 2048
LEAST_ROWS = 8
MOST_LANGUAGES = 256
NONE = "und"

MARKUP = r"""(?i)<html[^>]*\slang\s*=\s*["']?([a-z]{2,3})"""
HOST = r"^[a-z]+://([^/:?#]+)"


def trigrams(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of each text between two blanks, and the n + 1 row offsets.

    ASCII letters are in lower case, and anything else below 0x80 is a blank.  A text of n bytes
    has n trigrams.
    """
    data, offsets = raw(texts)
    sizes = np.diff(offsets)
    padded = np.full(len(data) + 2 * len(sizes), 0x20, np.uint32)
    padded[np.arange(len(data)) + np.repeat(2 * np.arange(len(sizes)) + 1, sizes)] = _PLAIN[data]
    at = np.arange(len(data)) + np.repeat(2 * np.arange(len(sizes)), sizes)
    found = padded[at] * 0x9E3779B1 + padded[at + 1] * 0x85EBCA6B + padded[at + 2] * 0xC2B2AE35
    return (found >> np.uint32(17)).astype(np.int64), offsets


_PLAIN = np.array([c if c >= 0x80 else ord(chr(c).lower()) if chr(c).isalpha() else 0x20 for c in range(256)], np.uint8)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = strings(batch.column("text"))
        names = batch.column("declared").to_pylist()
        for low, high in slices(texts):
            found, offsets = trigrams(texts.slice(low, high - low))
            for name in set(names[low:high]):
                rows = [i for i in range(high - low) if names[low + i] == name]
                tally = np.bincount(np.concatenate([found[offsets[i] : offsets[i + 1]] for i in rows]), minlength=BUCKETS)
                at = np.flatnonzero(tally)
                yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(tally[at], pa.int64())], ["declared", "bucket", "n"])


def fit(rows: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, least_rows: int = LEAST_ROWS, most_languages: int = MOST_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities by bucket, from a sample of each declared language.

    The window keeps only the first rows of each language in every task before it shuffles, so a
    language of most rows costs no more than others.  At most BUCKETS counts for each language come
    to the driver.
    """
    declared = rows.where("declared is not null")
    counts = declared.groupBy("declared").agg(F.count("*").alias("n")).where(F.col("n") >= least_rows)
    named = [r["declared"] for r in counts.orderBy(F.desc("n"), "declared").limit(most_languages).collect()]
    rank = F.row_number().over(Window.partitionBy("declared").orderBy("_order", "doc_id"))
    picked = declared.where(F.col("declared").isin(named)).select("doc_id", "declared", F.xxhash64("doc_id").alias("_order")).withColumn("_rank", rank)
    picked = picked.where(F.col("_rank") <= rows_per_language).select("doc_id", "declared").distinct()
    sample = rows.select("doc_id", "declared", "text").join(F.broadcast(picked), ["doc_id", "declared"], "left_semi")
    tally = sample.select("declared", "text").mapInArrow(_counts, "declared string, bucket int, n long")
    found = tally.groupBy("declared", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(found["declared"].unique())
    table = np.zeros((len(names), BUCKETS))
    for k, name in enumerate(names):
        own = found[found["declared"] == name]
        table[k, own["bucket"]] = own["n"]
    table = np.log((table + 0.05) / (table.sum(1, keepdims=True) + 0.05 * BUCKETS)) if names else table
    return names, table.astype(np.float32)


def _likelihoods(table: np.ndarray):
    flat = np.float32(-np.log(BUCKETS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column("text"))
            parts = []
            for low, high in slices(texts):
                found, offsets = trigrams(texts.slice(low, high - low))
                sums = np.zeros((high - low, len(table) + 1))
                for k, row in enumerate(table):
                    total = np.concatenate([[0], np.cumsum(row[found], dtype=np.float64)])
                    sums[:, k] = total[offsets[1:]] - total[offsets[:-1]]
                sums[:, -1] = flat * np.diff(offsets)
                parts.append(sums)
            sums = np.concatenate([np.zeros((0, len(table) + 1)), *parts])
            lists = pa.ListArray.from_arrays(np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32), sums.ravel()) if len(sums) else pa.array([], pa.list_(pa.float64()))
            kept = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), lists], [*kept, "logs"])

    return run


def _logs(names: list[str], counts: str, total: str, prior: list[Column], weight: float) -> Column:
    """(count + weight * prior) / (total + weight) of each name."""
    one = lambda k, n: (F.coalesce(F.col(counts)[n], F.lit(0)) + weight * prior[k]) / (F.coalesce(F.col(total), F.lit(0)) + weight)
    return F.array(*(one(k, n) for k, n in enumerate(names)))


def _by(best: DataFrame, key: str) -> DataFrame:
    """One row per value of ``key``: counts by best language, and the total."""
    counts = best.groupBy(key, "best").agg(F.count("*").alias("n")).groupBy(key)
    return counts.agg(F.map_from_entries(F.collect_list(F.struct("best", "n"))).alias(f"{key}_counts"), F.sum("n").alias(f"{key}_total")).withColumnRenamed(key, f"_{key}")


def identify(docs: DataFrame, declared: str = "lang", host: str = "source", suffix: str | None = None, min_probability: float = 0.5, temper: float = 0.2, rows_per_language: int = ROWS_PER_LANGUAGE, carry: bool = False) -> DataFrame:
    """Language, probability and verdict of every row of ``docs`` (doc_id, text and the named columns).

    With ``carry`` the whole row comes along as the struct ``row``.
    """
    named = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    rows = docs.select("doc_id", named("text").alias("text"), F.lower(named(declared)).alias("declared"), named(host).alias("host"), named(suffix).alias("suffix"), *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []))
    small_batches(docs.sparkSession)
    own = ["row"] if carry else []
    names, table = fit(rows, rows_per_language)
    if not names:
        return rows.select("doc_id", F.lit(NONE).alias("language"), F.lit(0.0).alias("probability"), F.lit(False).alias("kept"), "declared", *own)
    scored = cut(rows.mapInArrow(_likelihoods(table), rows.drop("text").schema.add("logs", T.ArrayType(T.DoubleType()))), "language-likelihoods")
    all_names = [*names, NONE]
    best = F.element_at(F.array(*map(F.lit, all_names)), F.array_position("logs", F.array_max("logs")).cast("int"))
    best = F.when(F.array_min("logs") == F.array_max("logs"), F.lit(NONE)).otherwise(best)
    scored = scored.withColumn("best", best)

    whole = {r["best"]: r["n"] for r in scored.groupBy("best").agg(F.count("*").alias("n")).collect()}
    total = sum(whole.values())
    prior = [F.lit((whole.get(n, 0) + 1.0) / (total + len(all_names))) for n in all_names]
    joined = scored
    for key in ("suffix", "host", "declared"):
        joined = joined.join(cut(_by(scored, key), "language-counts"), F.col(key).eqNullSafe(F.col(f"_{key}")), "left").drop(f"_{key}")
    joined = joined.withColumn("by_suffix", _logs(all_names, "suffix_counts", "suffix_total", prior, 50.0))
    joined = joined.withColumn("by_host", _logs(all_names, "host_counts", "host_total", [F.col("by_suffix")[k] for k in range(len(all_names))], 20.0))
    # P(declared | language), up to the factor P(declared): P(language | declared) / P(language).
    joined = joined.withColumn("by_declared", _logs(all_names, "declared_counts", "declared_total", prior, 20.0))
    score = [temper * F.col("logs")[k] + F.log(F.col("by_host")[k]) + F.log(F.col("by_declared")[k]) - F.log(prior[k]) for k in range(len(all_names))]
    joined = joined.select("doc_id", "declared", F.array(*score).alias("score"), (F.array_max("logs") == F.array_min("logs")).alias("bare"), *own)
    top = F.array_max("score")
    probability = 1.0 / F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("score")))
    language = F.element_at(F.array(*map(F.lit, all_names)), F.array_position("score", top).cast("int"))
    return joined.select(
        "doc_id",
        F.when(F.col("bare"), F.lit(NONE)).otherwise(language).alias("language"),
        F.when(F.col("bare"), F.lit(0.0)).otherwise(F.round(probability, 6)).alias("probability"),
        (~F.col("bare") & (language != NONE) & (probability >= min_probability)).alias("kept"),
        "declared",
        *own,
    )


def page_columns(pages: DataFrame) -> DataFrame:
    """Pages as rows for :func:`identify`: text without tags, declared markup language, host and suffix."""
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    place = F.nullif(F.regexp_extract("url", HOST, 1), F.lit(""))
    return pages.select(
        F.col("page_id").alias("doc_id"),
        text.alias("text"),
        F.nullif(F.lower(F.regexp_extract("html", MARKUP, 1)), F.lit("")).alias("lang"),
        place.alias("source"),
        F.element_at(F.split(place, r"\."), -1).alias("suffix"),
    )

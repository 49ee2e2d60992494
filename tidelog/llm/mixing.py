"""Mixing sources to target weights.

Sizes are summed by source; targets follow the weights, up to a limit of repetition; the rate of
a source is target / size.  Each document is emitted floor(rate) times, and once more by a
hash-seeded draw whose probability is the fraction of the rate.  The draws of a source are
stratified: its documents are ordered by size class and, inside a class, by hash; from a
hash-seeded offset on, each passes if the running sum of the fraction crosses an integer there.
So every document is drawn with the probability of the fraction, and the words taken come near
the target also where a few long documents decide: neighbours in the order are of like size.

Cases: a null text has size 0; a null source is a source of its own, ordered last; rows with
equal doc_id, text and source are one draw and decide alike; ties of hashes go by doc_id and text;
texts of any length count whole; a source or corpus without words takes nothing; an empty table
gives an empty result; extra columns, whatever their names, stay in :func:`mix` and are ignored
by :func:`plan`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.shared import cut, small_batches
from tidelog.llm.textbytes import word_counts

WEIGHTS = (5.0, 2.0, 1.0)
#: Draws are integers of so many bits; those with the same first twelve are ranked together.
BITS = 28
RANKED = 12


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [n for n in batch.schema.names if n != "text"]
        sizes = pa.array(word_counts(batch.column("text")), pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), sizes], [*kept, "size"])


def targets(totals: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Adds ``target`` to one row per source (source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all sizes;
    a target stops at ``most`` times its source, and the excess goes to the others by weight.
    With a source's limit as ``most * source_size / weight`` in ascending order, the sources that
    stop are a prefix of that order, so running sums give the common level without iterating.
    The input is one row per source: an aggregate, not documents.
    """
    names = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(names) - 1) % len(weights)) + 1)
    limits = totals.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "weight", F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    limits = limits.withColumns(
        {
            "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "weights_left": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
            "all": share * F.sum("source_size").over(whole),
        }
    )
    # The level if exactly the sources before this one stop; this one stops if its limit is lower.
    level = (F.col("all") - F.col("capped")) / F.col("weights_left")
    limits = limits.withColumn("level", level).withColumn("stops", F.col("cap") / F.col("weight") < F.col("level"))
    level = F.min(F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole)["level"]
    target = F.when(F.col("stops"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * level))
    return limits.select("source", "source_size", target.alias("target"))


def _number(key: Column) -> Column:
    """The first BITS bits of the MD5 of a string."""
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")


def text_key() -> Column:
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _class(size: Column) -> Column:
    """Sizes in classes an eighth wide at most, in order: binary length and leading digits."""
    digits = F.bin(size)
    return F.concat(F.lpad(F.length(digits).cast("string"), 2, "0"), F.substring(F.rpad(digits, 4, "0"), 1, 4))


def _equal(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(and_, (left[n].eqNullSafe(right[n]) for n in names))


KEY = ["doc_id", "source", "text_key"]


def draws(sized: DataFrame, seed: int, share: float, most: float) -> DataFrame:
    """The copies of each distinct (doc_id, source, text_key), with the source's size, target and rate.

    Ranks along a source come from a running count of classes and hash buckets, and a window inside
    each bucket; no task sees a whole source.
    """
    key = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_key", F.lit(str(seed)))
    keys = sized.groupBy(*KEY).agg(F.first("size").alias("size"), F.count("*").alias("rows"))
    keys = keys.withColumn("class", _class(F.col("size") * F.col("rows"))).withColumn("draw", _number(key))
    keys = cut(keys.withColumn("bucket", F.shiftright("draw", BITS - RANKED).cast("int")), "mixing-keys")
    histogram = keys.groupBy("source", "class", "bucket").agg(F.count("*").alias("n"))
    before = lambda *names: F.coalesce(F.sum("n").over(Window.partitionBy(*names[:-1]).orderBy(names[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = histogram.groupBy("source", "class").agg(F.sum("n").alias("n")).select("source", "class", before("source", "class").alias("class_base"))
    buckets = histogram.select("source", "class", "bucket", before("source", "class", "bucket").alias("base"))
    histogram = buckets.join(classes, _equal(buckets, classes, ["source", "class"])).select(*(buckets[c] for c in ("source", "class", "bucket")), (F.col("base") + F.col("class_base")).alias("base"))
    inside = F.row_number().over(Window.partitionBy("source", "class", "bucket").orderBy("draw", "doc_id", "text_key")) - 1
    ranked = keys.withColumn("inside", inside)
    ranked = ranked.join(histogram, _equal(ranked, histogram, ["source", "class", "bucket"])).select(*(ranked[c] for c in KEY), (F.col("inside") + F.col("base")).alias("rank"))
    aims = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aims = aims.withColumn("rate", rate).withColumn("fraction", F.floor((F.col("rate") - F.floor("rate")) * float(1 << BITS)).cast("long"))
    aims = cut(aims.withColumn("offset", _number(F.concat_ws("/", F.coalesce("source", F.lit("")), F.lit(str(seed))))), "mixing-targets")  # a row per source
    crossed = lambda rank: F.shiftright(F.col("fraction") * rank + F.col("offset"), BITS)
    copies = F.floor("rate") + crossed(F.col("rank") + 1) - crossed(F.col("rank"))
    copies = F.least(copies.cast("long"), F.lit(int(most)))
    return ranked.join(aims, _equal(ranked, aims, ["source"])).select(*(ranked[c] for c in KEY), "source_size", F.col("target").cast("double"), "rate", copies.alias("copies"))


def _sized(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), text_key().alias("text_key"), "text")
    schema = rows.drop("text").schema.add("size", "long")
    return cut(rows.mapInArrow(_sizes, schema), "mixing-sizes")


def plan(docs: DataFrame, seed: int = 42, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, size, source, source_size, target, rate, copies and taken of every row of ``docs``."""
    sized = _sized(docs)
    drawn = draws(sized, seed, share, most)
    out = sized.join(drawn, _equal(sized, drawn, KEY))
    return out.select(sized["doc_id"], sized["text_key"], sized["source"], "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, seed: int = 42, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as planned, with the columns of ``docs``."""
    drawn = draws(_sized(docs), seed, share, most).where("copies > 0")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), text_key().alias("text_key"), row)
    joined = rows.join(drawn, _equal(rows, drawn, KEY)).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return joined.select("row.*")

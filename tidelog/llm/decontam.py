"""Benchmark decontamination by template windows.

Numbers, names and units are replaced by typed placeholders, so a question with other numbers or
names has the same template.  Windows of five words are hashed in three variants: the folded words
as they are; a template whose names are capitalised words inside a sentence; and one whose names
are all capitalised words, for names that open a sentence.  A window of a template tells only if
two of its words are literal, and a template counts if half of its windows tell.

The windows of documents are hash-joined with those of the benchmark.  An item is leaked if a text
holds at least 75 % of the distinct windows of one variant and, for a template, the slots agree:
each value of the item stands for one value of the document and the other way round, in at least
75 % of the slots that meet.

Steps, all of them Spark jobs: a Bloom filter of the benchmark's windows, of bounded size, goes to
all executors and only what passes it leaves a document; of the windows of an item only the
rarest that 75 % can't do without look for partners; pairs of text and item found so are compared
whole.  No other part of the
benchmark is broadcast, except where Spark finds a side of a join small enough.

Cases: a null or empty text leaks nothing; an item of two to four words is one literal window of
its own width, and one of a single word is found in texts of that word alone; texts and items of
any length are read whole; equal texts are compared once and answer alike; repeated rows and items
change nothing; items without id or text are ignored; where a window occurs several times in an
item, it is aligned to the place that continues the run before; empty tables give no leaks; extra
columns, whatever their names, are ignored by :func:`find` and stay in :func:`without_leaks`.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.shared import cut
from tidelog.llm.textbytes import Words, mix, slices, strings

WIDTH = 5
#: At most so many bits in the filter, and about so many for each window.
FILTER_BITS = 27
BITS_PER_WINDOW = 64
LITERAL, INNER, WIDE = range(3)
#: Words that are units after a number.
UNITS = "mm cm m km in ft yd mi mg g kg t lb oz ml l ms s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents usd eur gbp meter meters metre metres mile miles inch inches foot feet gram grams kilogram kilograms kilometer kilometers pound pounds liter liters litre litres degree degrees mph kph hz khz mhz ghz kb mb gb tb w kw v".split()
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0xA5A5A5A5A5A5A5A1, 0xA5A5A5A5A5A5A5A2, 0xA5A5A5A5A5A5A5A3))

_NUMERIC = np.zeros(256, bool)
_NUMERIC[list(b"0123456789.,:/-+%$")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:")] = True


def _units() -> np.ndarray:
    return np.sort(Words.of(strings(pa.array([" ".join(UNITS)]))).hashes)


def templates(texts: pa.LargeStringArray) -> tuple[Words, list[tuple[np.ndarray, np.ndarray]]]:
    """Words (trimmed, lower case), and for each variant the words' hashes and which of them fill slots."""
    full, words = Words.of(texts), Words.of(texts, fold=True).trim()
    data, starts, ends = full.data, full.starts, full.ends
    literal = words.hashes, np.zeros(len(starts), bool)
    if not len(starts):
        return words, [literal] * 3
    total = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    numeric, digits, lines = total(_NUMERIC[data]), total(_DIGIT[data]), total(data == 0x0A)
    inside = lambda sums, a, b: sums[b] - sums[a]
    number = (inside(numeric, words.starts, words.ends) == words.ends - words.starts) & (inside(digits, words.starts, words.ends) > 0)
    attached = np.flatnonzero(~number & _DIGIT[data[words.starts]])
    if len(attached):  # 5kg: a number whose rest is a unit
        other = np.flatnonzero(~_NUMERIC[data])
        rest = words.cut(other[np.searchsorted(other, words.starts[attached])], words.ends[attached])
        number[attached[np.isin(rest.hashes, _units())]] = True
    opening = np.zeros(len(starts), bool)
    opening[full.first[:-1][full.counts > 0]] = True
    opening[1:] |= _STOP[data[ends[:-1] - 1]] | (inside(lines, ends[:-1], starts[1:]) > 0)
    letter = data[words.starts]
    capital = (letter >= 0x41) & (letter <= 0x5A) & ~number
    unit = np.zeros(len(starts), bool)
    unit[1:] = number[:-1] & ~opening[1:] & np.isin(words.hashes[1:], _units())
    out = [literal]
    for name in (capital & ~opening, capital):
        values = words.hashes.copy()
        for flags, value in ((number, NUMBER), (name, NAME), (unit, UNIT)):
            values[flags] = value
        out.append((values, number | name | unit))
    return words, out


def _starts(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and first word (of the slice) of each window; a window of one word is a text of that word alone."""
    counts = words.counts
    number = (counts == 1).astype(np.int64) if width == 1 else np.maximum(counts - width + 1, 0)
    row = np.repeat(np.arange(len(number)), number)
    return row, np.arange(len(row)) + np.repeat(words.first[:-1] - (np.cumsum(number) - number), number)


def _hash(values: np.ndarray, at: np.ndarray, kind: int, width: int) -> np.ndarray:
    """A hash of each window; both templates share theirs."""
    with np.errstate(over="ignore"):
        out = np.full(len(at), (width << 1) + (kind != LITERAL), np.uint64)
        for k in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + values[at + k]
        return mix(out)


def _among(flags: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """How many words of each window have the flag."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at + width] - total[at]


def _values(words: Words, slots: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The slot values in each window of five words; 0 for other words."""
    values = np.append(np.where(slots, words.hashes, 0), np.zeros(WIDTH, np.uint64))
    return values[at[:, None] + np.arange(WIDTH)]


def _probes(hashes: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << FILTER_BITS) - 1)
    again = mix(hashes)
    return [(x & mask).astype(np.int64) for x in (hashes, again, again >> np.uint64(32))]


ITEMS = "item_id long, kind int, width int, n int, windows array<long>, bits array<long>, i_places binary, i_hashes binary, i_values binary"


def _itemise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ids = strings(batch.column("text")), batch.column("item_id").to_pylist()
        rows = []
        for k, item in enumerate(ids):
            words, variants = templates(texts.slice(k, 1))
            size, seen = len(words.starts), set()
            for kind, (hashes, slots) in enumerate(variants if size >= WIDTH else variants[:1]):
                width = min(size, WIDTH)
                at = _starts(words, width)[1] if size else np.zeros(0, np.int64)
                tells = at[_among(slots, at, width) <= width - 2] if kind else at
                if not size or 2 * len(tells) < len(at) or kind and not slots.any() or (own := slots.tobytes()) in seen:
                    continue
                seen.add(own)
                at, found = tells, _hash(hashes, tells, kind, width)
                values = _values(words, slots, at) if kind else np.zeros(0, np.uint64)
                distinct = np.unique(found)
                bits = np.unique(np.concatenate(_probes(distinct)))
                rows.append((item, kind, width, len(distinct), distinct.view(np.int64).tolist(), bits.tolist(), at.astype(np.int32).tobytes(), found.tobytes(), values.tobytes()))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 3]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=[x.split()[0] for x in ITEMS.split(", ")])


def items_of(benchmark: DataFrame) -> DataFrame:
    """One row for each item and variant: distinct windows, and the places, hashes and slot values of all."""
    rows = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.distinct().mapInArrow(_itemise, ITEMS).withColumn("iid", F.monotonically_increasing_id())


def _filter(items: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter as 64-bit words, and the mask of its positions."""
    windows = items.agg(F.sum("n")).first()[0] or 0
    bits = min(FILTER_BITS, max(16, (BITS_PER_WINDOW * windows).bit_length()))
    at = items.select(F.explode("bits").alias("bit")).select(F.col("bit").bitwiseAND((1 << bits) - 1).alias("bit"))
    at = at.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[at["word"].to_numpy()] = at["bits"].to_numpy().view(np.uint64)
    return out, (1 << bits) - 1


HITS = "k1 long, k2 long, hashes array<long>, places binary, place_hashes binary, slot_values binary"


def _passes(bloom: np.ndarray, mask: int, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that pass the filter."""
    held = lambda bit: (bloom[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
    left = np.flatnonzero(held((hashes & np.uint64(mask)).astype(np.int64)))
    for k in (1, 2):
        left = left[held(_probes(hashes[left])[k] & mask)]
    return left


def _hits(shared, widths: list[int]):
    """For each text with windows that pass the filter: these windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, mask = shared.value
        for batch in batches:
            texts = strings(batch.column("text"))
            for low, high in slices(texts):
                words, variants = templates(texts.slice(low, high - low))
                (_, inner), (_, wide) = variants[INNER:]
                found = []
                for width, kinds in [(w, (LITERAL,)) for w in widths] + [(WIDTH, (LITERAL, INNER, WIDE))]:
                    all_rows, all_at = _starts(words, width)
                    for kind in kinds:
                        row, at = all_rows, all_at
                        hashes, slots = variants[kind]
                        if kind:
                            keep = _among(slots, at, width) <= width - 2
                            if kind == WIDE:  # what the other template doesn't have already
                                keep &= _among(inner != wide, at, width) > 0
                            row, at = row[keep], at[keep]
                        own = _hash(hashes, at, kind, width)
                        keep = _passes(bloom, mask, own)
                        row, at = row[keep], at[keep]
                        values = _values(words, slots, at) if len(keep) else np.zeros((0, WIDTH), np.uint64)
                        found.append((row, at - words.first[row], own[keep], values))
                row, place, own, values = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(row, kind="stable")
                row, place, own, values = row[order], place[order].astype(np.int32), own[order], values[order]
                starts = np.flatnonzero(np.diff(row, prepend=-1))
                spans = [slice(a, b) for a, b in zip(starts, np.append(starts[1:], len(row)))]
                at = pa.array(low + row[starts])
                arrays = [
                    batch.column("k1").take(at),
                    batch.column("k2").take(at),
                    pa.array([np.unique(own[x]).view(np.int64) for x in spans], pa.list_(pa.int64())),
                    *(pa.array([y[x].tobytes() for x in spans], pa.binary()) for y in (place, own, values)),
                ]
                yield pa.record_batch(arrays, names=[x.split()[0] for x in HITS.split(", ")])

    return run


def agreement(doc: tuple[np.ndarray, np.ndarray, np.ndarray], item: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
    """The share of slots that agree, of those that meet; each side is (places, hashes, slot values) of windows.

    A window of the document is laid on the item's place that continues the run before, or else on
    the next place of its hash, or the first: one place each, so the work is linear.
    """
    where: dict[int, list[int]] = defaultdict(list)
    for k, h in enumerate(item[1].tolist()):
        where[h].append(k)
    index = {int(p): k for k, p in enumerate(item[0])}
    met: dict[tuple[int, int], tuple[int, int]] = {}
    shift, last = None, -1
    for place, h, values in zip(doc[0].tolist(), doc[1].tolist(), doc[2].tolist()):
        own = where.get(h)
        if own is None:
            continue
        k = index.get(place - shift) if shift is not None else None
        if k is None or item[1][k] != h:
            k = own[int(np.searchsorted(own, last, "right")) % len(own)]
        last, shift = k, place - int(item[0][k])
        for t, (value, theirs) in enumerate(zip(values, item[2][k].tolist())):
            if theirs:
                met[place + t, int(item[0][k]) + t] = (theirs, value)
    pairs = Counter(met.values())
    if not pairs:
        return 1.0
    forth, back = {}, {}
    for (theirs, value), n in sorted(pairs.items()):
        forth[theirs] = max(forth.get(theirs, (0, 0)), (n, value))
        back[value] = max(back.get(value, (0, 0)), (n, theirs))
    return sum(n for theirs, (n, value) in forth.items() if back[value][1] == theirs) / sum(pairs.values())


def _agreeing(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("places", "place_hashes", "slot_values", "i_places", "i_hashes", "i_values")
        for batch in batches:
            keep = []
            for kind, *parts in zip(*(batch.column(c).to_pylist() for c in ("kind", *names))):
                sides = [(np.frombuffer(a, np.int32), np.frombuffer(h, np.uint64), np.frombuffer(v, np.uint64).reshape(-1, WIDTH)) for a, h, v in (parts[:3], parts[3:])] if kind else []
                keep.append(not kind or agreement(*sides) >= share)
            yield batch.select(["k1", "k2", "item_id", "coverage"]).filter(pa.array(keep, pa.bool_()))

    return run


def text_keys() -> list[Column]:
    """Two hashes that tell texts apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.75) -> DataFrame:
    """k1, k2, items (ids of leaked items, in order) and coverage (the largest) of the texts that leak any."""
    spark = docs.sparkSession
    items = cut(items_of(benchmark), "benchmark-items")
    bloom = spark.sparkContext.broadcast(_filter(items))
    widths = [r[0] for r in items.where(F.col("width") < WIDTH).select("width").distinct().collect()]  # 1 to 4 at most
    rows = docs.select(*text_keys(), F.col("text").cast("string").alias("text"))
    hits = cut(rows.mapInArrow(_hits(bloom, sorted(widths)), HITS).dropDuplicates(["k1", "k2"]), "benchmark-hits")

    need = F.ceil(F.col("n") * share)
    postings = items.select("iid", "n", F.explode("windows").alias("hash"))
    frequency = postings.groupBy("hash").agg(F.count("*").alias("frequency"))
    rarest = F.row_number().over(Window.partitionBy("iid").orderBy("frequency", "hash"))
    seeking = postings.join(frequency, "hash").withColumn("rank", rarest).where(F.col("rank") <= F.col("n") - need + 1).select("iid", "hash")
    pairs = hits.select("k1", "k2", F.explode("hashes").alias("hash")).join(seeking, "hash").select("k1", "k2", "iid").distinct()
    covered = F.size(F.array_intersect("hashes", "windows"))
    # The hits grow with the corpus, and far more in memory than their files tell: never a broadcast side.
    whole = pairs.join(hits.hint("merge"), ["k1", "k2"]).join(items, "iid").where(covered >= need).withColumn("coverage", covered / F.col("n"))
    found = whole.drop("hashes", "windows", "bits", "iid", "n", "width").mapInArrow(_agreeing(share), "k1 long, k2 long, item_id long, coverage double")
    return found.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("coverage").alias("coverage"))


def find(docs: DataFrame, benchmark: DataFrame, share: float = 0.75) -> DataFrame:
    """doc_id, leaked, items (ids of leaked items) and coverage (the largest) of every row of ``docs``."""
    found = leaks(docs, benchmark, share)
    rows = docs.select("doc_id", *text_keys()).join(found, ["k1", "k2"], "left")
    return rows.select(
        "doc_id",
        F.col("items").isNotNull().alias("leaked"),
        F.coalesce("items", F.array().cast("array<long>")).alias("items"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.75) -> DataFrame:
    """The rows of ``docs`` that leak no item."""
    found = cut(leaks(docs, benchmark, share).select("k1", "k2"), "benchmark-leaks")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return docs.select(*text_keys(), row).join(found, ["k1", "k2"], "left_anti").select("row.*")

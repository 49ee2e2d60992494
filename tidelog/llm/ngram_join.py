"""N-gram Jaccard self-join and its connected components: a grouped prefix join.

Two sets of word shingles with a Jaccard similarity of at least t share one of their
``n - ceil(t n) + 1`` first shingles in any order common to all sets.  The order here is by
document frequency, counted over all documents, so that prefixes hold the rarest shingles and
most documents, whose prefix occurs nowhere else, need no partner at all.

Steps, each a Spark job on the shuffled result of the one before:

1. Blocks of documents send their distinct shingles (the first 40 to 52 bits of the hash, the more
   the larger the corpus) to hash ranges, packed as arrays; equal sets in a block are sent once.
2. Each range counts frequencies and returns the shingles that two sets share.
3. Each block's sets get their prefix: shared shingles after the unshared ones, rarest first.
   Sets whose prefix has no shared shingle are done.
4. Sets with the same prefix and size form a group.  Groups meet by shingle; pairs of groups are
   filtered by size and by position in the prefix, then expanded to their members and verified.

Only connections matter, so the groups of a shingle are first compared with one hub, then one
in 32 of the pairs that are still in different components, and then all pairs that still are,
however many remain.  A dense family is thus connected without listing its pairs, and no bucket
is capped.

A set's identity is a 64-bit hash of its shingles' hashes; equality of shingles is that of the bits
that travel.  Two sets of 300 shingles hold a chance agreement in one of 10**7 pairs or fewer.

Cases: a null or empty text, or one without words, has no shingles and is its own component; with
fewer words than the width the whole text is one shingle; texts of any length are read whole; rows
with equal doc_id are treated by their text; a row without doc_id counts for a component's id and
for its kept document only where no other row does; ties of documents are broken by two hashes of
the row; an empty table gives an empty result; extra columns, whatever their names, are ignored by
:func:`join` and stay in :func:`one_per_component`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.components import components
from tidelog.llm.shared import Scratch, cut
from tidelog.llm.textbytes import Words, mix, slices, strings

WIDTH = 5
PERCENT = 75
BLOCK_BYTES = 2 << 20
BLOCK_ROWS = 1 << 16
RANGE_TOKENS = 1 << 20
PARTS = (32, 1)
SKETCH_WORDS = 8


def shingle_sets(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted; the n + 1 offsets; and the identity of each set."""
    hashes, offsets = Words.of(texts, fold=True).windows(WIDTH)
    own = [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
    sizes = np.array([len(x) for x in own], np.int64)
    flat = np.concatenate([np.zeros(0, np.uint64), *own])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat ^ np.uint64(0x2545F4914F6CDD1D)), dtype=np.uint64)])
        sets = mix(total[bounds[1:]] - total[bounds[:-1]] + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return flat, bounds, sets.view(np.int64)


def _identities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the column ``text`` of each batch by the size and the identity of its set."""
    for batch in batches:
        texts, sizes, sets = strings(batch.column("text")), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low, high in slices(texts):
            _, bounds, own = shingle_sets(texts.slice(low, high - low))
            sizes.append(np.diff(bounds))
            sets.append(own)
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(sets))], [*kept, "n_shingles", "sid"])


#: Ranges are at least and at most two to these powers; above FINE, blocks grow with them.
LEAST_BITS, FINE, MOST_BITS = 8, 16, 20


def _blocks(bits: int):
    """Rows (block, range, tokens, doc numbers); one row of each block also describes its sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        for batch in batches:
            all_texts = strings(batch.column("text"))
            for first in range(0, len(all_texts), BLOCK_ROWS):
                texts = all_texts.slice(first, BLOCK_ROWS)
                for low, high in slices(texts, BLOCK_BYTES << max(0, bits - FINE)):
                    rows = _block(texts.slice(low, high - low), block, bits)
                    if rows is not None:
                        yield rows
                        block += 1

    return run


def _block(texts: pa.LargeStringArray, block: int, bits: int) -> pa.RecordBatch | None:
    flat, bounds, sets = shingle_sets(texts)
    sizes = np.diff(bounds)
    _, first = np.unique(sets, return_index=True)
    used = np.zeros(len(sets), bool)
    used[first] = True
    used &= sizes > 0
    if not used.any():
        return None
    entry = np.repeat(used, sizes)
    number = np.repeat(np.cumsum(used) - 1, sizes)[entry]
    token = flat[entry] >> np.uint64(32 - bits)
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (number[1:] != number[:-1])
    token, number = token[fresh], number[fresh].astype(np.uint16)
    distinct = np.bincount(number, minlength=used.sum())
    part = (token >> np.uint64(32)).astype(np.uint16 if bits <= FINE else np.uint32)
    order = np.argsort(part, kind="stable")
    part, low, number = part[order], token[order].astype(np.uint32), number[order]
    parts, starts = np.unique(part, return_index=True)
    ends = np.append(starts[1:], len(part))
    n = len(parts)
    described = [sets[used].tobytes(), sizes[used].astype(np.int32).tobytes(), distinct.astype(np.int32).tobytes()]
    return pa.record_batch(
        [
            pa.array([block] * n, pa.int64()),
            pa.array(parts, pa.int32()),
            pa.array([low[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
            pa.array([number[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
            *(pa.array([x] + [None] * (n - 1), pa.binary()) for x in described),
        ],
        ["block", "part", "tokens", "numbers", "sets", "sizes", "distinct"],
    )


SHARED = "bucket int, part int, blocks binary, places binary, numbers binary, tokens binary, frequency binary, block long, sets binary, sizes binary, distinct binary"


def _frequencies(buckets: int):
    """Of one hash range: the shared shingles with their frequency, packed by bucket of blocks."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        blocks = table["block"].to_numpy()
        tokens = [np.frombuffer(x, np.uint32) for x in table["tokens"].to_pylist()]
        numbers = [np.frombuffer(x, np.uint16) for x in table["numbers"].to_pylist()]
        place = np.repeat(np.arange(len(blocks)), [len(n) for n in numbers])
        token, number = np.concatenate(tokens), np.concatenate(numbers)
        order = np.argsort(token, kind="stable")
        token = token[order]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        lengths = np.diff(np.append(starts, len(token)))
        frequency = np.repeat(lengths, lengths)
        shared = frequency > 1
        token, order, frequency = token[shared], order[shared], np.minimum(frequency[shared], 0xFFFF).astype(np.uint16)
        place, number = place[order], number[order]
        bucket = blocks[place] % buckets
        order = np.argsort(bucket, kind="stable")
        token, place, number, frequency, bucket = token[order], place[order], number[order], frequency[order], bucket[order]
        found, starts = np.unique(bucket, return_index=True)
        rows = []
        for k, a, b in zip(found, starts, np.append(starts[1:], len(bucket))):
            own, places = np.unique(place[a:b], return_inverse=True)
            rows.append((int(k), key[0].as_py(), blocks[own].tobytes(), places.astype(np.uint32 if len(own) >> 16 else np.uint16).tobytes(), number[a:b].tobytes(), token[a:b].tobytes(), frequency[a:b].tobytes(), None, None, None, None))
        for b, *described in zip(blocks, *(table[c].to_pylist() for c in ("sets", "sizes", "distinct"))):
            if described[0] is not None:
                rows.append((int(b) % buckets, None, None, None, None, None, None, int(b), *described))
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.int64(), *[pa.binary()] * 3]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=[x.split()[0] for x in SHARED.split(", ")])

    return run


PREFIXES = "sid long, n int, skipped int, gkey long, prefix array<long>, shared binary, sketch array<long>"


def _sketch(shared: np.ndarray) -> list[int]:
    """A bitmap of hashed shingles; bits that differ bound the symmetric difference from below."""
    bits = np.zeros(64 * SKETCH_WORDS, bool)
    bits[(mix(shared) % np.uint64(len(bits))).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64).tolist()


def _prefixes(percent: int):
    """Of the sets of some blocks: those with shared shingles in their prefix."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        describe = {}
        for r in rows:
            if r["block"] is not None:
                describe[r["block"]] = tuple(np.frombuffer(r[c], t) for c, t in (("sets", np.int64), ("sizes", np.int32), ("distinct", np.int32)))
        docs, token, frequency = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)]
        for r in rows:
            if r["block"] is None:
                blocks, tokens = np.frombuffer(r["blocks"], np.int64), np.frombuffer(r["tokens"], np.uint32)
                places = np.frombuffer(r["places"], np.uint32 if len(blocks) >> 16 else np.uint16)
                docs.append((blocks[places] << 16) + np.frombuffer(r["numbers"], np.uint16))
                token.append((np.uint64(r["part"]) << np.uint64(32)) | tokens.astype(np.uint64))
                frequency.append(np.frombuffer(r["frequency"], np.uint16))
        docs, token, frequency = np.concatenate(docs), np.concatenate(token), np.concatenate(frequency)
        order = np.lexsort((token, frequency, docs))
        docs, token = docs[order], token[order]
        starts = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else np.zeros(0, np.int64)
        out: list[list] = [[] for _ in range(7)]
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(docs)).tolist()):
            sets, sizes, distinct = describe[int(docs[a]) >> 16]
            i = int(docs[a]) & 0xFFFF
            n = int(sizes[i])
            skipped = int(distinct[i]) - (b - a)
            take = n - (percent * n + 99) // 100 + 1 - skipped
            if take > 0:
                prefix = token[a : min(a + take, b)]
                with np.errstate(over="ignore"):
                    gkey = mix(np.cumsum(mix(prefix + np.arange(len(prefix), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)[-1:])
                shared = np.sort(token[a:b])
                for column, x in zip(out, (int(sets[i]), n, skipped, int(gkey.view(np.int64)[0]), prefix.astype(np.int64).tolist(), shared.tobytes(), _sketch(shared))):
                    column.append(x)
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds)], names=[x.split()[0] for x in PREFIXES.split(", ")])

    return run


def _verify(percent: int):
    """Keeps the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "x", "y"))):
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (n + m - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def prefixes(docs: DataFrame, tokens: int, percent: int = PERCENT) -> DataFrame:
    """Sets that may have a partner: identity, size, group key, shared prefix and shared shingles."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(MOST_BITS, max(LEAST_BITS, int(max(2 * partitions, tokens // RANGE_TOKENS) - 1).bit_length()))
    buckets = max(8, (1 << bits) // 2)
    packed = docs.select("text").mapInArrow(_blocks(bits), "block long, part int, tokens binary, numbers binary, sets binary, sizes binary, distinct binary")
    shared = packed.groupBy("part").applyInArrow(_frequencies(buckets), SHARED)
    found = shared.groupBy("bucket").applyInArrow(_prefixes(percent), PREFIXES)
    # Copies in different blocks have the same prefix and shared shingles.
    found = found.groupBy("sid", "n", "skipped", "gkey").agg(F.first("prefix").alias("prefix"), F.first("shared").alias("shared"), F.first("sketch").alias("sketch"))
    return found.withColumn("m", (F.length("shared") / 8).cast("int"))


def links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets that link."""
    both = pairs.join(sets.alias("l"), F.col("a") == F.col("l.sid")).join(sets.alias("r"), F.col("b") == F.col("r.sid"))
    both = both.where((100 * F.least("l.n", "r.n") >= percent * F.greatest("l.n", "r.n")) & _alike(percent))
    return both.select("a", "b", F.col("l.n").alias("n"), F.col("r.n").alias("m"), F.col("l.shared").alias("x"), F.col("r.shared").alias("y")).mapInArrow(_verify(percent), "a long, b long")


def _need(percent: int) -> Column:
    """The least common shingles of two linked sets."""
    return F.ceil((F.col("l.n") + F.col("r.n")) * percent / (100.0 + percent))


def _alike(percent: int) -> Column:
    """Whether the sketches leave enough common shingles; unknown (null) for groups of several sets."""
    differ = sum((F.bit_count(F.col("l.sketch")[k].bitwiseXOR(F.col("r.sketch")[k])) for k in range(SKETCH_WORDS)), F.lit(0))
    held = F.col("l.m") + F.col("r.m")
    return F.coalesce(held - differ >= 2 * _need(percent), F.lit(True))


def _close(percent: int) -> Column:
    """Two postings of a shingle whose sets may link, if this is the first shingle that they share."""
    need = _need(percent)
    rest = 1 + F.least(F.col("l.n") - F.col("l.pos") - 1, F.col("r.n") - F.col("r.pos") - 1)
    return (100 * F.least("l.n", "r.n") >= percent * F.greatest("l.n", "r.n")) & (rest >= need)


def _hub_pairs(state: DataFrame, percent: int) -> DataFrame:
    """Each group with the first group, by a hash, of every list that it is in."""
    hubs = state.groupBy("token").agg(F.min(F.struct(F.xxhash64("gid"), "gid", "n")).alias("h")).select("token", "h.*")
    sized = 100 * F.least("l.n", "r.n") >= percent * F.greatest("l.n", "r.n")
    pairs = state.alias("l").join(hubs.alias("r"), (F.col("l.token") == F.col("r.token")) & (F.col("l.gid") != F.col("r.gid")) & sized)
    return pairs.select(F.col("l.gid").alias("p"), F.col("r.gid").alias("q")).distinct()


def _apart_pairs(state: DataFrame, percent: int, part: int) -> DataFrame:
    """One in ``part`` (by a hash) of the pairs of groups in different components that may link.

    A pair is made at the first shingle that its prefixes share, if sizes, positions and sketches
    leave enough common shingles.
    """
    different = F.col("l.label").isNull() | F.col("r.label").isNull() | (F.col("l.label") != F.col("r.label"))
    chosen = F.lit(True) if part == 1 else F.pmod(F.xxhash64("l.gid", "r.gid"), F.lit(part)) == 0
    first = ~F.arrays_overlap("l.before", "r.before")
    same = (F.col("l.token") == F.col("r.token")) & (F.col("l.gid") < F.col("r.gid"))
    pairs = state.alias("l").join(state.alias("r"), same & different & chosen & _close(percent) & _alike(percent) & first)
    return pairs.select(F.col("l.gid").alias("p"), F.col("r.gid").alias("q"))


def set_components(sets: DataFrame, percent: int = PERCENT, cut: Callable[[DataFrame, str], DataFrame] = cut) -> DataFrame:
    """(node, label) of the sets of :func:`prefixes` that link with another one."""
    alone = F.when(F.count("*") == 1, F.first("sketch"))  # sets of one group differ behind the prefix
    groups = sets.groupBy("gkey", "n").agg(F.min("sid").alias("gid"), *(F.first(c).alias(c) for c in ("prefix", "skipped", "m")), alone.alias("sketch"))
    groups = cut(groups, "ngram-groups")
    members = cut(sets.select("sid", "gkey", "n").join(groups.select("gkey", "n", "gid"), ["gkey", "n"]).select("gid", "sid"), "ngram-members")
    postings = groups.select("gid", "n", "skipped", F.posexplode("prefix").alias("pos", "token"))
    postings = postings.select("token", "gid", "n", (F.col("pos") + F.col("skipped")).alias("pos"))
    lists = postings.groupBy("token").agg(F.count("*").alias("size")).where("size > 1").select("token")
    state = postings = cut(postings.join(lists, "token"), "ngram-postings")
    details = groups.select("gid", "m", "sketch", "prefix", "skipped")

    known = labels = None
    for part in (0, *PARTS):
        if part == 0:
            inner = members.where("gid <> sid").select(F.col("gid").alias("a"), F.col("sid").alias("b"))
            pairs = _hub_pairs(state, percent).select(F.col("p").alias("a"), F.col("q").alias("b")).unionByName(inner)
        else:
            labelled = members.join(labels, members["sid"] == labels["node"], "left").select("gid", "sid", F.coalesce("label", "sid").alias("label"))
            in_group = labelled.groupBy("gid").agg(F.min("label").alias("low"), F.max("label").alias("high"))
            in_group = cut(in_group.select("gid", F.when(F.col("low") == F.col("high"), F.col("low")).alias("label")), "ngram-group-labels")
            state = postings.join(in_group, "gid")
            mixed = F.max(F.col("label").isNull().cast("int")).alias("mixed")
            open_lists = state.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), mixed, F.count("*").alias("size"))
            open_lists = open_lists.where("low <> high or mixed = 1")
            if part > 1 and not (open_lists.where(F.col("size") > 2 * part).limit(1).count()):
                continue  # short lists only: all pairs at once
            state = state.join(open_lists.select("token"), "token").join(details, "gid")
            state = state.withColumn("before", F.slice("prefix", 1, F.col("pos") - F.col("skipped"))).drop("prefix", "skipped")
            state = cut(state, "ngram-open")
            mixed_groups = in_group.where("label is null").select(F.col("gid").alias("p"), F.col("gid").alias("q"))
            left = labelled.select(F.col("gid").alias("p"), F.col("sid").alias("a"), F.col("label").alias("la"))
            right = labelled.select(F.col("gid").alias("q"), F.col("sid").alias("b"), F.col("label").alias("lb"))
            pairs = _apart_pairs(state, percent, part).unionByName(mixed_groups).join(left, "p").join(right, "q").where("la <> lb and (p <> q or a < b)").select("a", "b")
        found = cut(links(pairs, sets, percent), "ngram-links")
        if part and found.isEmpty():
            continue
        known = found if known is None else known.unionByName(found)
        labels = components(known, cut)
    return labels


def row_keys() -> list[Column]:
    """Two hashes that tell rows apart by their id and text; never null."""
    parts = [F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"]
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(7), *parts).alias("k2")]


def memberships(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, the keys of the row, n_shingles, sid, label and component_id of every row of ``docs``.

    ``label`` names the component (null without shingles); component_id is its smallest doc_id.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    own = rows.select("doc_id", *row_keys(), "text").mapInArrow(_identities, "doc_id long, k1 long, k2 long, n_shingles long, sid long")
    own = cut(own, "ngram-identities")
    tokens = own.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0
    scratch = Scratch(docs.sparkSession, "ngram")
    sets = scratch.cut(prefixes(rows, tokens, percent), "prefixes")
    labels = set_components(sets, percent, scratch.cut)
    smallest = own.where("n_shingles > 0").groupBy("sid").agg(F.min("doc_id").alias("set_min"))
    placed = smallest.join(labels.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "set_min", F.coalesce("label", "sid").alias("label"))
    best = scratch.cut(placed.groupBy("label").agg(F.min("set_min").alias("component_id")), "smallest")
    placed = cut(placed.join(best, "label").select(F.col("sid").alias("own_sid"), "label", "component_id"), "ngram-components")
    scratch.drop()
    out = own.join(placed, (F.col("sid") == F.col("own_sid")) & (F.col("n_shingles") > 0), "left").drop("own_sid")
    return out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))


def join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text)."""
    return memberships(docs, percent).select("doc_id", "n_shingles", "component_id")


def one_per_component(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of each component the row of its smallest doc_id; rows without shingles all stay, once each."""
    placed = memberships(docs, percent)
    best = placed.where("n_shingles > 0").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("r")).select("r.k1", "r.k2")
    winners = best.unionByName(placed.where("n_shingles = 0").select("k1", "k2").distinct())
    rows = docs.select(*row_keys(), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).groupBy("k1", "k2").agg(F.first("row").alias("row"))
    return rows.join(winners, ["k1", "k2"], "left_semi").select("row.*")

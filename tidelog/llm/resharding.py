"""Resharding by minimum-cost flow.

A layout is a folder of bundles (``bundle=N``, Parquet files with the rows of some units of one
shard) and a manifest, a table of the units: shard, bundle, rows and bytes of each.  A unit is a
block of documents by a hash of their text; a block that is too large for one unit is dealt out
by a second hash of the text, and a text that is too large alone by a hash of doc_id.

Resharding solves, on the driver, the transport problem of old shard sizes and new capacities:
keeping a byte costs nothing, moving one costs one.  What must leave a shard is met by the set of
its units with the least total that suffices (a subset sum), and each mover goes where the flow
has room.  Only bundles that lose units are rewritten, and movers arrive in bundles of their own:
all other files stay as they are.  The new manifest is written last and names the bundles that
count, so a run that dies leaves the old layout valid, and a second run duplicates nothing.

The driver gets the units: at most ``blocks``, plus ``parts`` for each block, or ``cells`` for each
text, above the limit, of which there are few since together they can't exceed all bytes.

Cases: a null text has one byte, as an empty one; texts of any length are one row; equal texts
stay together unless they alone exceed the limit; ties in a unit's order (equal doc_id) are broken
by crc32 and size, and repeated rows get slots of their own; rows without doc_id are of one cell;
an empty table gives an empty result; extra columns, whatever their names, travel inside the
struct ``row``.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.shared import cut, fresh_folder

MANIFEST = "unit long, shard int, bundle int, rows long, bytes long"
GRAINS = 1 << 16
EXACT = 1024


def min_cost_flow(supply: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard that use the capacities at the least cost.

    Successive shortest paths (Bellman-Ford on the residual network), for a few dozen shards.
    Capacities must suffice.
    """
    n, m = len(supply), len(capacity)
    end = n + m + 1
    edges: list[list[int]] = []  # to, room, cost
    at: list[list[int]] = [[] for _ in range(end + 1)]

    def connect(a: int, b: int, room: int, cost: int) -> None:
        at[a].append(len(edges))
        edges.append([b, room, cost])
        at[b].append(len(edges))
        edges.append([a, 0, -cost])

    for i, x in enumerate(supply):
        connect(0, 1 + i, x, 0)
        for j in range(m):
            connect(1 + i, 1 + n + j, x, int(i != j))
    for j, x in enumerate(capacity):
        connect(1 + n + j, end, x, 0)
    while True:
        cost, via = {0: 0}, {}
        changed = {0}
        while changed:
            reached = set()
            for a in sorted(changed):
                for e in at[a]:
                    b, room, c = edges[e]
                    if room and cost[a] + c < cost.get(b, 1 << 60):
                        cost[b], via[b] = cost[a] + c, e
                        reached.add(b)
            changed = reached
        if end not in cost:
            break
        path, node = [], end
        while node:
            path.append(via[node])
            node = edges[via[node] ^ 1][0]
        push = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= push
            edges[e ^ 1][1] += push
    return {(i, edges[e][0] - 1 - n): edges[e ^ 1][1] for i in range(n) for e in at[1 + i] if not e % 2 and edges[e ^ 1][1]}


def least_subset(sizes: list[int], excess: int) -> list[int]:
    """Places of the values with the least sum of at least ``excess``; the last ones where sums tie.

    Exact while the excess is at most GRAINS; above, values count in grains of excess / GRAINS,
    rounded down, and the sum exceeds the least one by at most a grain a value.  Of more than
    2 * EXACT values, the last are taken until about EXACT more suffice, which are then chosen from
    the 2 * EXACT before.
    """
    if excess <= 0:
        return []
    if len(sizes) > 2 * EXACT:
        end, spare = len(sizes), EXACT * sum(sizes) // len(sizes)
        while end > 2 * EXACT and excess - sizes[end - 1] > spare:
            end -= 1
            excess -= sizes[end]
        start = max(0, end - 2 * EXACT)
        while start and sum(sizes[start:end]) < excess:  # far smaller ones before large ones
            start = max(0, start - EXACT)
        return [start + k for k in _least_subset(sizes[start:end], excess)] + list(range(end, len(sizes)))
    return _least_subset(sizes, excess)


def _least_subset(sizes: list[int], excess: int) -> list[int]:
    grain = -(-excess // GRAINS)
    values = [s // grain for s in sizes]
    need = -(-excess // grain)
    most = need + max(values)
    reach, sums = [], 1
    mask = (1 << (most + 1)) - 1
    for v in values:
        reach.append(sums)
        sums |= (sums << v) & mask
    over = sums >> need
    if not over:
        return list(range(len(sizes)))
    left = need + (over & -over).bit_length() - 1
    chosen = []
    for k in reversed(range(len(values))):
        if values[k] <= left and reach[k] >> (left - values[k]) & 1 and (values[k] or not reach[k] >> left & 1):
            chosen.append(k)
            left -= values[k]
    return chosen[::-1]


def transfers(units: list[tuple[int, int, int]], shards: int) -> dict[int, int]:
    """The new shard of each unit; units are (id, old shard, bytes), in the order of their bundles.

    New shards have capacities at most one byte apart, raised where units are indivisible.
    """
    by_old: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for unit, old, size in units:
        by_old[old].append((unit, size))
    total = sum(size for *_, size in units)
    capacity = [total // shards + (j < total % shards) for j in range(shards)]
    return fit(by_old, capacity)


def fit(by_old: dict[int, list[tuple[int, int]]], capacity: list[int]) -> dict[int, int]:
    """The new shard of each unit, given the (unit, bytes) of each old shard and the capacities."""
    supply = [sum(size for _, size in by_old.get(i, [])) for i in range(max([*by_old, -1]) + 1)]
    flow = min_cost_flow(supply, capacity)
    out: dict[int, int] = {}
    movers: list[tuple[int, int, int]] = []
    room = list(capacity)
    for old, own in by_old.items():
        leave = set(least_subset([size for _, size in own], supply[old] - flow.get((old, old), 0)))
        for k, (unit, size) in enumerate(own):
            if k in leave:
                movers.append((size, unit, old))
            else:
                out[unit] = old
                room[old] -= size
    for size, unit, old in sorted(movers, key=lambda x: (-x[0], x[1])):
        fits = [j for j in range(len(room)) if j != old and room[j] >= size]
        # Where it fits: along the flow first, and then tightly; where it doesn't, to the most room.
        shard = min(fits, key=lambda j: (not flow.get((old, j)), room[j], j)) if fits else max(range(len(room)), key=lambda j: (room[j], -j))
        out[unit] = shard
        room[shard] -= size
    return out


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _hash(text: Column, seed: int, parts: int) -> Column:
    return F.pmod(F.xxhash64(text, F.lit(seed)), F.lit(parts))


@dataclass
class Units:
    """How documents are dealt out to units: by block, part of a large block, or cell of a large text."""

    blocks: int
    parts: int
    cells: int
    large_blocks: tuple[int, ...] = ()
    large_parts: tuple[int, ...] = ()

    def part(self) -> Column:
        return (_hash(_text(), 5, self.blocks) * self.parts + _hash(_text(), 6, self.parts)).cast("long")

    def cell(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.cells)).cast("long")

    def unit(self) -> Column:
        part = self.part()
        block = F.floor(part / self.parts).cast("long")
        whole = F.when(block.isin(*self.large_blocks), part) if self.large_blocks else F.when(F.lit(False), part)
        whole = whole.otherwise(block * self.parts) * self.cells
        return F.when(part.isin(*self.large_parts), part * self.cells + self.cell()).otherwise(whole) if self.large_parts else whole


def units_of(docs: DataFrame, shards: int, blocks: int, parts: int, cells: int) -> tuple[Units, list[tuple[int, int, int]]]:
    """The units of a corpus, and (unit, rows, bytes) of each."""
    units = Units(blocks, parts, cells)
    size = (F.octet_length(_text()) + 1).cast("long")
    measure = lambda df: df.agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    stats = cut(measure(docs.select(units.part().alias("part"), size.alias("size")).groupBy("part")), "shard-parts")
    block = F.floor(F.col("part") / parts).cast("long")
    by_block = stats.groupBy(block.alias("block")).agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).collect()
    limit = sum(r["bytes"] for r in by_block) / shards / 2
    units.large_blocks = tuple(sorted(r["block"] for r in by_block if r["bytes"] > limit))  # at most 2 * shards
    out = [(r["block"] * parts * cells, r["rows"], r["bytes"]) for r in by_block if r["bytes"] <= limit]
    if units.large_blocks:
        by_part = stats.where(block.isin(*units.large_blocks)).collect()
        units.large_parts = tuple(sorted(r["part"] for r in by_part if r["bytes"] > limit))
        out += [(r["part"] * cells, r["rows"], r["bytes"]) for r in by_part if r["bytes"] <= limit]
    if units.large_parts:
        own = docs.select(units.part().alias("part"), units.cell().alias("cell"), size.alias("size")).where(F.col("part").isin(*units.large_parts))
        out += [(r["part"] * cells + r["cell"], r["rows"], r["bytes"]) for r in measure(own.groupBy("part", "cell")).collect()]
    return units, sorted(out)


def _row(docs: DataFrame) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def _write(rows: DataFrame, folder: str) -> None:
    rows.write.partitionBy("bundle").mode("append").option("compression", "zstd").parquet(f"{folder}/bundles")


def _manifest(spark: SparkSession, folder: str, generation: int, rows: list[tuple]) -> None:
    frame = spark.createDataFrame(rows, MANIFEST).coalesce(1)
    frame.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/manifest-{generation}")


def manifest(spark: SparkSession, folder: str, generation: int) -> list[tuple]:
    """(unit, shard, bundle, rows, bytes) of a layout's units, by shard, bundle and unit."""
    return [tuple(r) for r in spark.read.schema(MANIFEST).parquet(f"{folder}/manifest-{generation}").orderBy("shard", "bundle", "unit").collect()]


def lay_out(docs: DataFrame, folder: str, shards: int = 12, bundles: int = 16, bundle_bytes: int = 256 << 20, blocks: int = 8192, parts: int = 1024, cells: int = 1024) -> None:
    """Writes ``docs`` as a layout of ``shards`` shards, ranges of units of about equal bytes.

    A shard has ``bundles`` bundles, or as many as ``bundle_bytes`` each take if that is more.
    """
    spark = docs.sparkSession
    units, found = units_of(docs, shards, blocks, parts, cells)
    total, before, rows = sum(size for *_, size in found), 0, []
    bundles = max(bundles, total // shards // bundle_bytes)
    for unit, count, size in found:
        bundle = min(before * shards * bundles // max(1, total), shards * bundles - 1)
        rows.append((unit, bundle // bundles, bundle, count, size))
        before += size
    places = spark.createDataFrame([r[:3] for r in rows], "unit long, shard int, bundle int")
    keyed = docs.select(units.unit().alias("unit"), "doc_id", F.crc32(F.encode(_text(), "UTF-8")).cast("long").alias("crc"), F.octet_length(_text()).alias("size"), _row(docs))
    keyed = keyed.join(F.broadcast(places), "unit").repartition("bundle")  # a row of ``places`` per unit
    rank = F.row_number().over(Window.partitionBy("bundle", "unit").orderBy("doc_id", "crc", "size")) - 1
    _write(keyed.select("bundle", "unit", rank.cast("long").alias("rank"), "row"), folder)
    _manifest(spark, folder, 0, rows)


def schema_of(docs: DataFrame) -> T.StructType:
    """The columns of a bundle's files, for documents like ``docs``."""
    row = T.StructField("row", T.StructType(docs.schema.fields))
    return T.StructType([T.StructField("unit", T.LongType()), T.StructField("rank", T.LongType()), row, T.StructField("bundle", T.IntegerType())])


def reshard(spark: SparkSession, folder: str, schema: T.StructType, shards: int = 16, generation: int = 0) -> list[int]:
    """Moves units so that ``shards`` shards have equal capacities; returns the bundles that were rewritten.

    Bundles that lose units are written again without them, and movers into new bundles.  The
    manifest of the next generation makes the change count.
    """
    old = manifest(spark, folder, generation)
    new = transfers([(unit, shard, size) for unit, shard, _, _, size in old], shards)
    affected = {bundle for unit, shard, bundle, *_ in old if new[unit] != shard}
    free = 1 + max((bundle for _, _, bundle, *_ in old), default=-1)
    numbers: dict[tuple, int] = {}
    rows = []
    for unit, shard, bundle, count, size in old:
        if bundle in affected:
            bundle = numbers.setdefault((new[unit], bundle), free + len(numbers))
        rows.append((unit, new[unit], bundle, count, size))
    if affected:
        places = spark.createDataFrame([(unit, bundle) for unit, _, bundle, *_ in rows if bundle >= free], "unit long, new int")
        held = spark.read.schema(schema).parquet(f"{folder}/bundles").where(F.col("bundle").isin(*sorted(affected)))
        moved = held.drop("bundle").join(F.broadcast(places), "unit").withColumnRenamed("new", "bundle").repartition("bundle")
        # A run that died may have left bundles of these numbers.
        _clear(spark, [f"{folder}/bundles/bundle={b}" for b in range(free, free + len(numbers))])
        _write(moved.sortWithinPartitions("bundle", "unit", "rank"), folder)
    _manifest(spark, folder, generation + 1, rows)
    return sorted(affected)


def _clear(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def read(spark: SparkSession, folder: str, schema: T.StructType, generation: int) -> DataFrame:
    """The rows of a layout with shard and slot; slots count a shard's rows without gaps, by unit and rank."""
    placed, slots = [], defaultdict(int)
    for unit, shard, bundle, rows, _ in sorted(manifest(spark, folder, generation), key=lambda r: (r[1], r[0])):
        placed.append((unit, bundle, shard, slots[shard]))
        slots[shard] += rows
    places = spark.createDataFrame(placed, "unit long, bundle int, shard int, base long")
    live = sorted({bundle for _, bundle, *_ in placed})
    held = spark.read.schema(schema).parquet(f"{folder}/bundles").where(F.col("bundle").isin(*live)) if live else spark.createDataFrame([], schema)
    return held.join(F.broadcast(places), ["unit", "bundle"]).select("shard", (F.col("base") + F.col("rank")).alias("slot"), "bundle", "row")


def move(docs: DataFrame, old_shards: int = 12, shards: int = 16, **layout: int) -> DataFrame:
    """Lays ``docs`` (doc_id, text) out in old shards, moves it to new ones, and describes each row from their files."""
    spark = docs.sparkSession
    rows, folder = docs.select("doc_id", "text"), fresh_folder(docs.sparkSession, "shards")
    lay_out(rows, folder, old_shards, **layout)
    reshard(spark, folder, schema_of(rows), shards)
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    last = max((bundle for _, _, bundle, *_ in manifest(spark, folder, 0)), default=-1)
    return read(spark, folder, schema_of(rows), 1).select(
        "row.doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        (F.col("bundle") > last).alias("rewritten"),
    )

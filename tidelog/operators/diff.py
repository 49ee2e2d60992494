"""Comparing two logs event by event.

Two pointers walk along the logs.  Equal heads match and similar heads (two of effective
timestamp, type and body equal) pair up; else the head with the smaller timestamp, compared as
text, is unmatched (of equal timestamps the first log's).  Each step depends on all before it.

Walks from different places mostly come together soon.  So walkers begin all along the logs at once,
at likely places, and each goes on a little past the start of the next.  Where its walk comes to a
place of a later walker, the later one's steps hold; the chain of them from the start is the walk.
A walker that meets no other goes on by windows of bounded size until it does, so that a wrong
start costs time and never changes the result.  Nothing but such windows meets in a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.text import effective_timestamp_text
from tidelog.operators.positional import running
from tidelog.sources.tables import written

MATCHING, SIMILAR, UNMATCHED_A, UNMATCHED_B = "matching", "similar", "unmatched_a", "unmatched_b"
WINDOW = 100_000
#: Rows of each side that a walker may take at once, however small the window: each round is a Spark job.
LEAST_WINDOW = 256
FORKED = "IdempotentStreamForked"


def diff_events(log: DataFrame) -> DataFrame:
    """position, effective timestamp as text (empty if absent), event type and body."""
    return log.select("position", effective_timestamp_text(F.col("metadata").cast("string")).alias("ts"), F.col("event_type").alias("type"), F.col("data").alias("body"))


def agreeing(a: str = "a", b: str = "b") -> Column:
    """How many of timestamp, type and body are equal: 3 is a match, 2 a similarity."""
    return sum(F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")).cast("int") for c in ("ts", "type", "body"))


def walk(a: list[tuple], b: list[tuple]) -> tuple[list[tuple], int, int]:
    """(class, index in a, index in b) until one list ends, and how far each was walked."""
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        same = sum(x == y for x, y in zip(a[i], b[j]))
        if same >= 2:
            out.append((MATCHING if same == 3 else SIMILAR, i, j))
            i, j = i + 1, j + 1
        elif a[i][0] <= b[j][0]:
            out.append((UNMATCHED_A, i, None))
            i += 1
        else:
            out.append((UNMATCHED_B, None, j))
            j += 1
    return out, i, j


def _starts(a: DataFrame, b: DataFrame, n: int, m: int, step: int) -> list[tuple[int, int]]:
    """Places (index in a, index in b) from which walks begin, at most about ``step`` rows apart.

    Where both logs first reach a timestamp, a walk is likely to have both heads; ``mts`` is the
    running maximum.  Within long ties the two sides are guessed to advance together.
    """
    marks = a.where(F.col("idx") % step == 0).select("mts").union(b.where(F.col("idx") % step == 0).select("mts"))
    cuts = np.array(sorted(r["mts"] for r in marks.distinct().collect()), dtype=object)
    passed = F.pandas_udf(lambda ts: pd.Series(np.searchsorted(cuts, ts.to_numpy(object), side="right")), "long")
    reached = []
    for side, size in ((a, n), (b, m)):
        first = {r["k"]: r["x"] for r in side.groupBy(passed("mts").alias("k")).agg(F.min("idx").alias("x")).collect()}
        at = [size] * (len(cuts) + 1)
        for k in reversed(range(len(cuts))):
            at[k] = first.get(k + 1, at[k + 1])
        reached.append(at)
    places = sorted({(0, 0), *zip(*reached), (n, m)})
    out = []
    for (i, j), (x, y) in zip(places, places[1:]):
        out += [(min(i + k, x), min(j + k, y)) for k in range(0, max(x - i, y - j), step)]
    return [(i, j) for i, j in out if i < n and j < m]


def _near(side: DataFrame, ranges: list[tuple[int, int, int]], step: int) -> DataFrame:
    """The rows of each (walker, first index, end); blocks of indexes make it an equi-join."""
    blocks = [(w, x, y, k) for w, x, y in ranges for k in range(x // step, (y - 1) // step + 1)]
    wanted = side.sparkSession.createDataFrame(blocks, "w long, lo long, hi long, block long")
    joined = side.withColumn("block", F.floor(F.col("idx") / step)).join(F.broadcast(wanted), "block")
    return joined.where("idx >= lo and idx < hi").select("w", "idx", "ts", "type", "body")


def _walk_windows(a: DataFrame, b: DataFrame, at: dict[int, tuple[int, int, int]]) -> DataFrame:
    """Each walker goes on from its place and step number ``at``, in one task for each, until a window ends.

    Gives the place before each step, and the place reached with a null class.
    """

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        i, j, n = at[key[0]]
        left, right = (x.sort_values("idx") for x in (left, right))
        rows = [[(t or "", k, bytes(v) if isinstance(v, (bytes, bytearray)) else v) for t, k, v in zip(x["ts"], x["type"], x["body"])] for x in (left, right)]
        steps = []
        for kind, x, y in walk(*rows)[0]:
            steps.append((key[0], n, i, j, kind))
            i, j, n = i + (x is not None), j + (y is not None), n + 1
        return pd.DataFrame([*steps, (key[0], n, i, j, None)], columns=["w", "n", "i", "j", "class"])

    return a.groupBy("w").cogroup(b.groupBy("w")).applyInPandas(run, "w long, n long, i long, j long, class string")


def _chain(n: int, m: int, ends: dict[int, tuple], meets: dict[int, tuple]) -> tuple[list[tuple], int | None]:
    """(walker, first step, end, seq of the first) of the one walk from the start; and the walker it still waits for."""
    parts, w, at, seq = [], 0, 0, 0
    while True:
        if w in meets:
            leave, other, theirs = meets[w]
        elif ends[w][0] == n or ends[w][1] == m:
            return [*parts, (w, at, ends[w][2], seq)], None
        else:
            return parts, w
        if at < leave:
            parts.append((w, at, leave, seq))
            seq += leave - at
        w, at = other, theirs + max(0, at - leave)


def _walked(a: DataFrame, b: DataFrame, n: int, m: int, window: int) -> tuple[DataFrame, int, int, int]:
    """The steps (seq, class, a_idx, b_idx) of the walk from the start, and seq and places at its end."""
    window = max(window, LEAST_WINDOW)
    step, slack = window // 8, window // 16
    starts = _starts(a, b, n, m, step)
    following = [*starts[1:], (n, m)]
    at = {w: (i, j, 0) for w, (i, j) in enumerate(starts)}
    reach = {w: (x - i + slack, y - j + slack) for w, ((i, j), (x, y)) in enumerate(zip(starts, following))}
    beyond = a.sparkSession.createDataFrame([(w, x, y) for w, (x, y) in enumerate(following)], "w long, x long, y long")
    ends, tried, taken = {}, dict.fromkeys(at, 0), None
    while at:
        ranges = [[(w, p[k], min(size, p[k] + min(window, reach.get(w, (window, window))[k]))) for w, p in at.items()] for k, size in ((0, n), (1, m))]
        fresh = written(_walk_windows(_near(a, ranges[0], step), _near(b, ranges[1], step), at), "diff-walk")
        taken = fresh if taken is None else taken.unionByName(fresh)
        ends |= {r["w"]: (r["i"], r["j"], r["n"]) for r in fresh.where("class is null").collect()}
        # Where a walk comes to a place from which a later walker has stepped, that one's steps hold.
        late = taken.join(F.broadcast(beyond), "w").where("i >= x and j >= y").select("w", "n", "i", "j")
        known = taken.where("class is not null").select(F.col("w").alias("other"), F.col("n").alias("theirs"), "i", "j")
        met = late.join(known, ["i", "j"]).where("other > w").groupBy("w").agg(F.min(F.struct("n", -F.col("other"), "theirs")).alias("x"))
        meets = {r["w"]: (r["x"][0], -r["x"][1], r["x"][2]) for r in met.collect()}
        parts, waiting = _chain(n, m, ends, meets)
        if waiting is None:
            break
        # All go on that have met no other yet, but each only thrice; then only the one that is waited for.
        going = [w for w, (i, j, _) in ends.items() if w == waiting or w > waiting and w not in meets and i < n and j < m and tried[w] < 3]
        at, reach = {w: ends[w] for w in going}, {}
        for w in going:
            tried[w] += 1
    place = a.sparkSession.createDataFrame(parts, "w long, lo long, hi long, first long")
    own = taken.where("class is not null").join(F.broadcast(place), "w").where("n >= lo and n < hi")
    steps = own.select((F.col("first") + F.col("n") - F.col("lo")).alias("seq"), "class", F.when(F.col("class") != UNMATCHED_B, F.col("i")).alias("a_idx"), F.when(F.col("class") != UNMATCHED_A, F.col("j")).alias("b_idx"))
    w, lo, hi, first = parts[-1]
    return steps, first + hi - lo, ends[w][0], ends[w][1]


def diff(a: DataFrame, b: DataFrame, window: int = WINDOW) -> DataFrame:
    """seq (from 0), class, a_position and b_position of the comparison of two :func:`diff_events`."""
    sides = []
    for name, log in (("a", a), ("b", b)):
        indexed = running(log, {"idx": ("count", None), "mts": ("max", F.coalesce("ts", F.lit("")))}).withColumn("idx", F.col("idx") - 1)
        sides.append(written(indexed, f"diff-{name}"))
    left, right = sides
    n, m = left.count(), right.count()
    i = j = seq = 0
    parts = []
    if n and m:
        steps, seq, i, j = _walked(left, right, n, m, window)
        parts.append(steps)
    none = F.lit(None).cast("long")
    parts.append(left.where(F.col("idx") >= i).select((F.col("idx") - i + seq).alias("seq"), F.lit(UNMATCHED_A).alias("class"), F.col("idx").alias("a_idx"), none.alias("b_idx")))
    seq += n - i
    parts.append(right.where(F.col("idx") >= j).select((F.col("idx") - j + seq).alias("seq"), F.lit(UNMATCHED_B).alias("class"), none.alias("a_idx"), F.col("idx").alias("b_idx")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    a_side = left.select(F.col("idx").alias("a_idx"), F.col("position").alias("a_position"), F.col("ts").alias("a_ts"), F.col("type").alias("a_type"))
    b_side = right.select(F.col("idx").alias("b_idx"), F.col("position").alias("b_position"), F.col("ts").alias("b_ts"), F.col("type").alias("b_type"))
    out = out.join(a_side, "a_idx", "left").join(b_side, "b_idx", "left")
    return out.select("seq", "class", "a_position", "b_position", "a_ts", "a_type", "b_ts", "b_type")


def broadcast(compared: DataFrame, *listeners: Callable[[DataFrame], None]) -> DataFrame:
    """Hands one comparison to several listeners; it is walked once, since it is written before."""
    once = written(compared, "diff-compared")
    for listener in listeners:
        listener(once)
    return once


def summary(compared: DataFrame) -> DataFrame:
    """Per class, side and type: how many, and the timestamps met first and last."""
    sides = [compared.where(f"{s}_position is not null").select("seq", "class", F.lit(s).alias("side"), F.col(f"{s}_type").alias("type"), F.col(f"{s}_ts").alias("ts")) for s in "ab"]
    both = sides[0].unionByName(sides[1])
    return both.groupBy("class", "side", "type").agg(F.count("*").alias("n"), F.min_by("ts", "seq").alias("first_ts"), F.max_by("ts", "seq").alias("last_ts"))


def samples(compared: DataFrame, limit: int = 1000) -> DataFrame:
    """The first ``limit`` rows of each class, in order; a top-k that is cut before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("class").orderBy("seq"))
    return compared.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def write_samples(compared: DataFrame, folder: str, limit: int = 1000) -> None:
    samples(compared, limit).orderBy("class", "seq").write.mode("overwrite").csv(folder, sep="\t", header=True)


def fork_source(fork: DataFrame) -> tuple[str, str, int]:
    """Category, id and last number of the stream that ``fork`` (one stream) was forked from."""
    first = fork.orderBy("event_number").limit(1).select("event_type", F.col("data").cast("string").alias("d")).collect()
    if not first or first[0]["event_type"] != FORKED:
        raise ValueError("a forked stream must begin with " + FORKED)
    spark, body = fork.sparkSession, first[0]["d"]
    row = spark.createDataFrame([(body,)], "d string").select(
        F.regexp_extract("d", r'"category"\s*:\s*"([^"]*)"', 1).alias("c"), F.regexp_extract("d", r'"id"\s*:\s*"([^"]*)"', 1).alias("i"), F.regexp_extract("d", r'"lastWrittenEventNumber"\s*:\s*(\d+)', 1).alias("n")
    ).first()
    return row["c"], row["i"], int(row["n"])


def forked_pair(log: DataFrame, category: str, id_: str) -> tuple[DataFrame, DataFrame]:
    """The original's events after the fork, and the fork's after its first event."""
    own = lambda c, i: log.where((F.col("stream_category") == c) & (F.col("stream_id") == i))
    fork = own(category, id_)
    source_category, source_id, last = fork_source(fork)
    return own(source_category, source_id).where(F.col("event_number") > last), fork.where("event_number > 0")

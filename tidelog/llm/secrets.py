"""Secret scan: fixed patterns plus a token-efficiency test.

Text that a public vocabulary was built for costs few tokens per character; random strings cost
many.  A candidate is a run of letters, digits and ``+/_=-``, with single dots inside; it is
reported as ``random`` when it has few characters per token, after known digests (hexadecimal
strings of digest length) and identifiers (UUIDs, plain numbers) are excluded.  A candidate of
letters alone may be a word of a language that the vocabulary knows little of, and needs fewer.

Cases: a null or empty text has no spans; a text of any length is scanned whole, in time in
proportion to it; spans of fixed patterns stay where a random string would overlap them, and ties
of starts are ordered by kind; equal rows give equal rows; an empty table gives an empty result;
extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm import memory  # noqa: F401  for its effect on workers

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX_LONG = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*")
LEAST = 16
UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I)
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
NUMBER = re.compile(r"[0-9.+/_=-]+")

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tiktoken encoding of a vocabulary file of ranks; one per Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def excluded(string: str) -> bool:
    """Known digests and identifiers."""
    bare = string.strip("=-_/+")
    return bool(NUMBER.fullmatch(string) or UUID.fullmatch(bare) or DIGEST.fullmatch(bare) and len(bare) in DIGEST_LENGTHS)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of the fixed patterns, by start and kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # A run of hexadecimal digits can only start where none stands before it.
    found += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    return sorted(found)


def random_spans(text: str, base: list[tuple[int, int, int]], path: str, ratio: float, letters_ratio: float) -> list[tuple[int, int, int]]:
    """Spans of random strings that overlap none of ``base``, which is in order."""
    out, at, last = [], 0, 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        if end - start < LEAST:
            continue
        while at < len(base) and base[at][0] < end:
            last, at = max(last, base[at][2]), at + 1
        if last > start or excluded(m[0]):
            continue
        if (end - start) / len(encoding(path).encode_ordinary(m[0])) <= (letters_ratio if m[0].isalpha() else ratio):
            out.append((start, 3, end))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, vocabulary: str, ratio: float = 1.9, letters_ratio: float = 1.5) -> DataFrame:
    """Secrets of every row of ``docs`` (doc_id, text): counts, and spans in code points.

    ``vocabulary`` is a tiktoken rank file, ``ratio`` the most characters per token of a random
    string, and ``letters_ratio`` that of one of letters alone.  One pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                extra = random_spans(text, base, vocabulary, ratio, letters_ratio)
                for k in range(3):
                    rows[k].append(sum(x[1] == k for x in base))
                rows[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
                rows[4].append(joined(sorted(base + extra)))
                rows[5].append(len(extra))
            arrays = [batch.column("doc_id").cast(pa.int64()), *(pa.array(x, pa.int64()) for x in rows[:3]), *(pa.array(x, pa.string()) for x in rows[3:5]), pa.array(rows[5], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)

"""Vectorised views of Arrow string columns: words, lines, hashes and word windows.

All functions work on the UTF-8 bytes of a column with numpy, a few megabytes at a time, so a
task's memory is bounded by the longest text and not by the size of a batch.  A *word* is a
maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidelog.llm import memory  # noqa: F401  for its effect on workers

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PUNCTUATION = np.array([0x20 < c < 0x7F and not chr(c).isalnum() for c in range(256)])
_SOLID = ~(_PUNCTUATION | _SPACE)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64, kept between calls."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            with np.errstate(over="ignore"):
                steps = np.full(n + 1, base, np.uint64)
                steps[0] = 1
                _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def strings(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """The column as one large-string array; null becomes the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 row offsets into them."""
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.LargeStringArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, of one row at least."""
    _, offsets = raw(texts)
    low = 0
    while low < len(texts):
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), len(texts))
        yield low, high
        low = high


def sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between consecutive offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


@dataclass
class Words:
    """The words of a slice of texts."""

    data: np.ndarray
    offsets: np.ndarray
    fold: bool = False

    @classmethod
    def of(cls, texts: pa.LargeStringArray, fold: bool = False) -> Words:
        data, offsets = raw(texts)
        return cls(_LOWER[data] if fold else data, offsets)

    @cached_property
    def space(self) -> np.ndarray:
        return _SPACE[self.data]

    def _edges(self, before: bool) -> np.ndarray:
        if not len(self.data):
            return np.zeros(0, np.int64)
        edge = np.empty(len(self.data), bool)
        full = self.offsets[:-1] < self.offsets[1:]
        if before:
            edge[0], edge[1:] = True, self.space[:-1]
            edge[self.offsets[:-1][full]] = True
        else:
            edge[-1], edge[:-1] = True, self.space[1:]
            edge[self.offsets[1:][full] - 1] = True
        return np.flatnonzero(edge & ~self.space)

    @cached_property
    def starts(self) -> np.ndarray:
        return self._edges(True)

    @cached_property
    def ends(self) -> np.ndarray:
        """Exclusive byte ends."""
        return self._edges(False) + 1

    @cached_property
    def first(self) -> np.ndarray:
        """For each row the index of its first word, and the number of words at the end."""
        return np.searchsorted(self.starts, self.offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @cached_property
    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        power, inverse = _power_tables(len(self.data) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_CODES[self.data] * power[: len(self.data)], out=total[1:])
            own = (total[self.ends] - total[self.starts]) * inverse[self.starts]
            return mix(own + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def trim(self) -> Words:
        """The same words without ASCII punctuation at either end; a word of nothing else stays."""
        starts, ends = self.starts, self.ends
        if len(starts):
            own = _SOLID[self.data]
            solid, count = np.flatnonzero(own), np.zeros(len(own) + 1, np.int32 if len(own) < 1 << 31 else np.int64)
            np.cumsum(own, out=count[1:])
            low, high = count[starts], count[ends]
            some = low < high
            starts, ends = starts.copy(), ends.copy()
            starts[some], ends[some] = solid[low[some]], solid[high[some] - 1] + 1
        out = self.cut(starts, ends)
        out.__dict__["first"] = self.first
        return out

    def cut(self, starts: np.ndarray, ends: np.ndarray) -> Words:
        """Other pieces of the same bytes, in place of the words."""
        out = Words(self.data, self.offsets)
        out.__dict__ |= {"space": self.space, "starts": starts, "ends": ends}
        return out

    def text(self, k: int) -> str:
        return self.data[self.starts[k] : self.ends[k]].tobytes().decode(errors="replace")

    def characters(self) -> np.ndarray:
        """Code points inside the words of each row."""
        return sums(~self.space & ((self.data & 0xC0) != 0x80), self.offsets)

    def windows(self, width: int, values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of ``width`` words, and the n + 1 row offsets into them.

        A row with fewer words, but one at least, has one window: all its words.  ``values``
        stand for the words in place of their own hashes.
        """
        values = self.hashes if values is None else values
        counts, first = self.counts, self.first
        last = np.repeat(first[1:], counts)
        where = np.arange(len(self.starts))
        short = (counts > 0) & (counts < width)
        whole = where + width <= last
        at = where[whole]
        with np.errstate(over="ignore"):
            out = np.zeros(len(at), np.uint64)
            for k in range(width):
                out = mix(out + values[at + k] * np.uint64(0xFF51AFD7ED558CCD))
        number = np.maximum(counts - width + 1, 0) * (counts >= width) + short
        offsets = np.concatenate([[0], np.cumsum(number)])
        if not short.any():
            return out, offsets
        all_out = np.zeros(offsets[-1], np.uint64)
        all_out[np.repeat(~short, number)] = out
        for row in np.flatnonzero(short):
            value = np.full(1, 0x5851F42D4C957F2D, np.uint64)
            for k in range(first[row], first[row + 1]):
                with np.errstate(over="ignore"):
                    value = mix(value + values[k : k + 1] * np.uint64(0xFF51AFD7ED558CCD))
            all_out[offsets[row]] = value[0]
        return all_out, offsets


def word_counts(column: pa.Array) -> np.ndarray:
    """Words in each text of a column; 0 where it is null."""
    texts = strings(column)
    parts = [Words.of(texts.slice(a, b - a)).counts for a, b in slices(texts)]
    return np.concatenate([np.zeros(0, np.int64), *parts])

"""A log with its readers and, where it can be written, its store."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.positions import LONG, Codec
from tidelog.functions.positions import merged as merged_codec
from tidelog.functions.positions import stitched as stitched_codec
from tidelog.operators import merge, reads, stitch
from tidelog.sources.store import LogStore
from tidelog.streaming.health import store_status


class Unsupported(NotImplementedError):
    """This source can't do that."""


@dataclass(frozen=True)
class LogSource:
    """Readers over a log.  ``store`` is where it is written; without one it is read-only.

    ``whole_only`` marks derived logs (merged, rekeyed), of which neither categories nor streams can
    be read because their ids or order are made up; of a stitched log ``streams`` can't.
    """

    log: Callable[[], DataFrame]
    store: LogStore | None = None
    whole_only: bool = False
    codec: Codec = LONG
    streams: bool = True

    @classmethod
    def of_store(cls, store: LogStore) -> LogSource:
        return cls(lambda: store.log, store)

    def _parts(self, streams: bool = False) -> DataFrame:
        if self.whole_only or streams and not self.streams:
            raise Unsupported("only the whole log can be read" if self.whole_only else "streams can't be read")
        return self.log()

    def read_all(self, after: int | None = None) -> DataFrame:
        return reads.read_all_forwards(self.log(), after)

    def read_all_backwards(self, before: int | None = None) -> DataFrame:
        return reads.read_all_backwards(self.log(), before)

    def read_last_event(self) -> DataFrame:
        return reads.read_last_event(self.log())

    def read_categories(self, *categories: str, after: int | None = None) -> DataFrame:
        return reads.read_categories_forwards(self._parts(), categories, after)

    def read_category_backwards(self, category: str, before: int | None = None) -> DataFrame:
        return reads.read_category_backwards(self._parts(), category, before)

    def read_stream(self, category: str, id_: str, after: int = -1) -> DataFrame:
        return reads.read_stream_forwards(self._parts(True), category, id_, after)

    def read_stream_backwards(self, category: str, id_: str, before: int | None = None) -> DataFrame:
        return reads.read_stream_backwards(self._parts(True), category, id_, before)

    def write(self, category: str, id_: str, events: list[tuple], expected_version: int | None = None) -> None:
        if self.store is None:
            raise Unsupported("this source is read-only")
        self.store.write(category, id_, events, expected_version)

    def apply(self, op: Callable[[DataFrame], DataFrame]) -> LogSource:
        """The transformed log, to be read as a whole."""
        return LogSource(lambda: op(self.log()), whole_only=True, codec=self.codec)

    def status(self) -> tuple[str, str]:
        return store_status(self.log())


@dataclass(frozen=True)
class Derived(LogSource):
    """A log in an order of its own, read on from positions as ``codec`` renders them."""

    read: Callable[[tuple | None, tuple[str, ...] | None], DataFrame] = None
    order: tuple[str, ...] = ()

    def _on(self, after: str | None, categories: tuple[str, ...] | None = None) -> DataFrame:
        return self.read(None if after is None else self.codec.parse(after), categories)

    def read_all(self, after: str | None = None) -> DataFrame:
        return self._on(after).orderBy(*self.order)

    def read_all_backwards(self, before: str | None = None) -> DataFrame:
        if before is not None:
            raise Unsupported("a derived log is read backwards from its end only")
        return self._on(None).orderBy(*(F.desc(c) for c in self.order))

    def read_last_event(self) -> DataFrame:
        return self.read_all_backwards().limit(1)

    def read_categories(self, *categories: str, after: str | None = None) -> DataFrame:
        self._parts()
        return self._on(after, categories).orderBy(*self.order)

    def read_category_backwards(self, category: str, before: str | None = None) -> DataFrame:
        self._parts()
        if before is not None:
            raise Unsupported("a derived log is read backwards from its end only")
        return self._on(None, (category,)).orderBy(*(F.desc(c) for c in self.order))


def merged(sources: dict[str, LogSource], key, snapshot=None) -> Derived:
    """Sources merged by a key; read-only and whole.

    The codec of the result is that of one position per input; its rows have ``position_<name>``.
    """
    codec = merged_codec({n: s.codec for n, s in sources.items()})

    def read(after: tuple | None, _: tuple | None = None) -> DataFrame:
        inputs = [merge.Input(n, s.log(), after[k] if after else None) for k, (n, s) in enumerate(sources.items())]
        return merge.merge(inputs, key, snapshot, positions=True)

    return Derived(lambda: read(None), whole_only=True, codec=codec, read=read, order=("merge_rank",))


def merged_by_effective_timestamp(sources: dict[str, LogSource], now=None, delay_seconds: int = 0) -> Derived:
    """By effective timestamp; with ``now`` each input ends before its first event later than ``now`` less the delay."""
    horizon = None if now is None else now - F.make_dt_interval(secs=F.lit(delay_seconds))
    return merged(sources, merge.by_effective_timestamp(), horizon)


def merged_in_order(sources: dict[str, LogSource]) -> Derived:
    """One source after the other."""
    return merged(sources, merge.by_stream_index())


def stitched(backfill: LogSource, live: LogSource, cutoff: int) -> Derived:
    """A backfill before a live log; the whole and its categories can be read, streams and writes can't."""

    def read(after: tuple | None, categories: tuple[str, ...] | None = None) -> DataFrame:
        parts = [s.log() if categories is None else reads.in_categories(s.log(), *categories) for s in (backfill, live)]
        return stitch.stitch(*parts, cutoff, *(after or (None, None)))

    return Derived(lambda: read(None), streams=False, codec=stitched_codec(backfill.codec, live.codec), read=read, order=("part", "position"))

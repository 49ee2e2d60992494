"""Positions as text: codecs and comparisons, used where a reader resumes."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Codec:
    """Text of a position and back, and an order (negative, 0 or positive)."""

    parse: Callable
    render: Callable
    compare: Callable


class NotComparable(ValueError):
    """Two positions have no order."""


def _order(a, b) -> int:
    return (a > b) - (a < b)


LONG = Codec(int, str, _order)
TEXT = Codec(str, str, _order)

SEPARATOR = "~~~"


def stitched(backfill: Codec, live: Codec) -> Codec:
    """``backfill~~~live``; ordered by the backfill part, then by the live part."""

    def parse(text: str) -> tuple:
        parts = text.split(SEPARATOR)
        if len(parts) != 2:
            raise ValueError(f"invalid stitched position: {text}")
        return backfill.parse(parts[0]), live.parse(parts[1])

    return Codec(
        parse,
        lambda p: f"{backfill.render(p[0])}{SEPARATOR}{live.render(p[1])}",
        lambda a, b: backfill.compare(a[0], b[0]) or live.compare(a[1], b[1]),
    )


def parallel_change(backfill: Codec, live: Codec, backfill_end, cutoff, migrated: bool) -> Codec:
    """Reads stitched and plain live positions while a store is migrated from one to the other.

    Before the migration both become stitched positions, after it plain live ones; then a
    position inside the backfill has no counterpart and is an error.  A position inside the
    backfill is before any live one; two of them aren't comparable.
    """
    both = stitched(backfill, live)

    def parse(text: str) -> tuple:
        if text.count(SEPARATOR) > 1:
            raise ValueError(f"nested stitched position: {text}")
        return both.parse(text) if SEPARATOR in text else (backfill_end, live.parse(text))

    def in_backfill(p: tuple) -> bool:
        return live.compare(p[1], cutoff) <= 0

    def render(p: tuple) -> str:
        if not migrated:
            return both.render(p)
        if in_backfill(p):
            raise ValueError(f"position is in the backfill: {both.render(p)}")
        return live.render(p[1])

    def compare(a: tuple, b: tuple) -> int:
        if in_backfill(a) and in_backfill(b):
            raise NotComparable(f"{both.render(a)} <=> {both.render(b)}")
        if in_backfill(a) or in_backfill(b):
            return -1 if in_backfill(a) else 1
        return live.compare(a[1], b[1])

    return Codec(parse, render, compare)


def rekeyed(underlying: Codec) -> Codec:
    """``number:underlying``, ordered by the underlying position."""

    def parse(text: str) -> tuple:
        number, mark, rest = text.partition(":")
        if not mark:
            raise ValueError(f"invalid rekeyed position: {text}")
        return int(number), underlying.parse(rest)

    return Codec(parse, lambda p: f"{p[0]}:{underlying.render(p[1])}", lambda a, b: underlying.compare(a[1], b[1]))


def merged(inputs: dict[str, Codec]) -> Codec:
    """A JSON object of one position per input; a partial order."""
    names = list(inputs)

    def parse(text: str) -> tuple:
        def pairs(items):
            keys = [k for k, _ in items]
            if len(set(keys)) != len(keys):
                raise ValueError(f"repeated input in position: {text}")
            return dict(items)

        found = json.loads(text, object_pairs_hook=pairs)
        if not isinstance(found, dict):
            raise ValueError(f"position is not an object: {text}")
        if set(found) != set(names):
            raise ValueError(f"position has other inputs than {names}: {text}")
        if not all(isinstance(v, str) for v in found.values()):
            raise ValueError(f"position has values that aren't text: {text}")
        return tuple(inputs[n].parse(found[n]) for n in names)

    def shown(p: tuple) -> str:
        return ";".join(f"{n}:{inputs[n].render(x)}" for n, x in zip(names, p))

    def compare(a: tuple, b: tuple) -> int:
        signs = {_order(inputs[n].compare(x, y), 0) for n, x, y in zip(names, a, b)} - {0}
        if len(signs) > 1:
            raise NotComparable(f"Not comparable: {shown(a)} <=> {shown(b)}")
        return signs.pop() if signs else 0

    return Codec(parse, lambda p: json.dumps({n: inputs[n].render(x) for n, x in zip(names, p)}, separators=(",", ":")), compare)


def merged_component(inputs: dict[str, Codec], name: str) -> Codec:
    """The merged codec ordered by one input alone."""
    whole, k = merged(inputs), list(inputs).index(name)
    return Codec(whole.parse, whole.render, lambda a, b: inputs[name].compare(a[k], b[k]))

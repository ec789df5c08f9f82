"""Entity spans inside a text column, as arrays of structs.

A span is STRUCT<entity, start, end, score, text>. ``start`` is a 0-based
character offset. Everything works inside one row, so texts are never shuffled.

Texts are scanned in Arrow batches: the pattern engine of the JVM functions gives no
offsets, and offsets, covers and choices built by array folds cost the square of the
number of spans. Here a scan is linear in the text and the sweeps over spans are a sort.
Patterns see ASCII classes (word boundaries, digits, white space).
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed

# (entity, pattern, score, hint). Hint: a literal, or several of which every match holds one;
# or a compiled anchor without white space, if every word of a match holds it or stands next
# to a word of the match that does; or None.
Hint = str | tuple[str, ...] | re.Pattern | None
Recognizer = tuple[str, str, float, Hint]

SPANS = "array<struct<entity:string,start:int,end:int,score:double,text:string>>"
_FIELDS = ("entity", "start", "end", "score", "text")
_WHITE = frozenset(" \t\n\r\f\v")
_AHEAD = re.compile(r"(\S*)\s*\S*", re.ASCII)  # rest of a word, and the next word

# The functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def recognizers_for(entities: Sequence[str],
                    registered: Sequence[Recognizer] = fixed.RECOGNIZERS) -> list[Recognizer]:
    """The registered recognizers of the given entities, in registration order."""
    return [r for r in registered if r[0] in entities]


def zones(text: str, anchor: re.Pattern) -> list[tuple[int, int]]:
    """Words that hold an anchor, with one word on either side; zones that meet are one."""
    found: list[tuple[int, int]] = []
    word = done = 0  # ends of the last anchored word and of its zone
    for hit in anchor.finditer(text):
        if hit.start() < word:
            continue
        start = _back(text, _back(text, _back(text, hit.start(), done, False), done, True), done, False)
        ahead = _AHEAD.match(text, hit.end())
        word = ahead.end(1)
        if found and start <= done:
            found[-1] = (found[-1][0], ahead.end())
        else:
            found.append((start, ahead.end()))
        done = ahead.end()
    return found


def _back(text: str, at: int, least: int, white: bool) -> int:
    """Start of the white space, or of the word, that ends at a place; not before ``least``."""
    while at > least and (text[at - 1] in _WHITE) == white:
        at -= 1
    return at


class Scanner:
    """Finds the spans of several recognizers, reading a text once per kind of hint.

    A recognizer whose literals are absent is skipped; one with an anchor looks only at
    the zones around it, and each anchor is searched once for all recognizers that have it.
    """

    def __init__(self, recognizers: Sequence[Recognizer]) -> None:
        self.parts = [(number, re.compile(pattern, re.ASCII), (hint,) if isinstance(hint, str) else hint)
                      for number, (_, pattern, _, hint) in enumerate(recognizers)]
        self.anchors = {hint for _, _, hint in self.parts if isinstance(hint, re.Pattern)}

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        """(recognizer, start, end) by recognizer, then place."""
        places = {anchor: zones(text, anchor) for anchor in self.anchors}
        found = []
        for number, pattern, hint in self.parts:
            if isinstance(hint, re.Pattern):
                for start, stop in places[hint]:
                    found += [(number, *m.span()) for m in pattern.finditer(text, start, stop)]
            elif hint is None or any(literal in text for literal in hint):
                found += [(number, *m.span()) for m in pattern.finditer(text)]
        return found


def _lists(sizes: np.ndarray, missing: np.ndarray, columns: Sequence[pa.Array]) -> pa.Array:
    offsets = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(list(columns), list(_FIELDS)),
                                    mask=pa.array(missing))


def _parts(spans: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, dict[str, np.ndarray]]:
    """Rows of the spans, missing rows, the flat structs and their numbers."""
    missing = spans.is_null().to_numpy(zero_copy_only=False)
    sizes = np.where(missing, 0, np.nan_to_num(spans.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
    flat = spans.flatten()
    numbers = {name: flat.field(name).to_numpy(zero_copy_only=False) for name in ("start", "end", "score")}
    return np.repeat(np.arange(len(sizes)), sizes), missing, flat, numbers


def _islands(row: np.ndarray, start: np.ndarray, end: np.ndarray, touching: bool) -> np.ndarray:
    """First span of each island, spans being in order of row and start."""
    wide = int(end.max(initial=0)) + 2
    reach = np.maximum.accumulate(end + row * wide)  # a later row's spans lie beyond all before
    at = start + row * wide
    new = at[1:] > reach[:-1] if touching else at[1:] >= reach[:-1]
    return np.flatnonzero(np.r_[True, new | (row[1:] != row[:-1])])


def cover(spans: pa.Array) -> pa.Array:
    """Arrow form of ``merge_cover``."""
    row, missing, flat, n = _parts(spans)
    if not len(row):
        return spans
    order = np.lexsort((-n["end"], n["start"], row))
    row, start, end, score = row[order], n["start"][order], n["end"][order], n["score"][order]
    first = _islands(row, start.astype(np.int64), end.astype(np.int64), touching=True)
    best = np.maximum.reduceat(score, first)
    size = np.diff(np.r_[first, len(row)])
    where = np.where(score == np.repeat(best, size), np.arange(len(row)), len(row))
    label = np.minimum.reduceat(where, first)
    return _lists(np.bincount(row[first], minlength=len(missing)), missing, [
        flat.field("entity").take(pa.array(order[label])), pa.array(start[first], pa.int32()),
        pa.array(np.maximum.reduceat(end, first), pa.int32()), pa.array(best, pa.float64()),
        flat.field("text").take(pa.array(order[first]))])


def _greedy(members: list[tuple[int, int]]) -> list[bool]:
    """Which of the spans, in order of choice, overlap none kept before."""
    kept: list[tuple[int, int]] = []  # disjoint, so only neighbours can clash
    out = []
    for start, end in members:
        at = bisect_left(kept, (start, end))
        clash = any(start < k[1] and k[0] < end for k in kept[max(0, at - 1):at + 1])
        out.append(not clash)
        if not clash:
            insort(kept, (start, end))
    return out


def winners(spans: pa.Array) -> pa.Array:
    """Arrow form of ``pick_winners``: the greedy choice runs only among spans that overlap."""
    row, missing, flat, n = _parts(spans)
    if not len(row):
        return spans
    choice = np.lexsort((n["start"], -n["score"], row))
    rank = np.empty(len(row), np.int64)
    rank[choice] = np.arange(len(row))
    order = np.lexsort((-n["end"], n["start"], row))
    start, end = n["start"][order].astype(np.int64), n["end"][order].astype(np.int64)
    first = _islands(row[order], start, end, touching=False)
    keep = np.ones(len(row), bool)
    size = np.diff(np.r_[first, len(row)])
    for a, b in zip(first[size > 1].tolist(), (first + size)[size > 1].tolist()):
        own = order[a:b][np.argsort(rank[order[a:b]])]
        keep[own] = _greedy(list(zip(n["start"][own].tolist(), n["end"][own].tolist())))
    chosen = choice[keep[choice]]
    picked = flat.take(pa.array(chosen))
    return _lists(np.bincount(row[chosen], minlength=len(missing)), missing, [picked.field(f) for f in _FIELDS])


def find(text: Column, recognizers: Sequence[Recognizer]) -> Column:
    """All spans of all recognizers over the whole text, by recognizer, then place."""
    chosen = list(recognizers)
    names = [r[0] for r in chosen]
    scores = np.array([r[2] for r in chosen], float)
    scanner = Scanner(chosen)

    def scan(texts: pa.Array) -> pa.Array:
        sizes, hits, words = [], [], []
        for value in texts.to_pylist():
            own = scanner.scan(value) if value else []
            sizes.append(len(own))
            hits += own
            words += [value[a:b] for _, a, b in own]
        which, start, end = np.array(hits, np.int64).reshape(-1, 3).T
        return _lists(np.array(sizes, np.int64), texts.is_null().to_numpy(zero_copy_only=False), [
            pa.array(names, pa.string()).take(pa.array(which)), pa.array(start, pa.int32()),
            pa.array(end, pa.int32()), pa.array(scores[which], pa.float64()), pa.array(words, pa.string())])

    return F.arrow_udf(scan, SPANS)(text)


def merge_cover(spans: Column) -> Column:
    """Union of overlapping or touching spans, so every detected character is covered.

    The merged span keeps the label of its best score, the earliest on ties.
    """
    return F.arrow_udf(cover, SPANS)(spans)


def pick_winners(spans: Column) -> Column:
    """Greedy choice by score, then start; a span that overlaps a kept one is dropped.

    Touching spans do not overlap. Result is in choice order.
    """
    return F.arrow_udf(winners, SPANS)(spans)

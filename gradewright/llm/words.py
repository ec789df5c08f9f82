"""Words of many texts at once, as arrays of byte places and 64-bit hashes.

A word is a run of bytes other than ASCII white space (0x20, 0x09-0x0D). UTF-8 never
uses those bytes inside a character, so words of bytes are words of characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import SPACE, mix

SEGMENT = 1 << 18  # bytes of text worked on at a time; a longer text is alone
_FILLED = ~np.isin(np.arange(256), list(SPACE))
_STEP = 1 << 12
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.r_[np.uint64(1), np.full(_STEP - 1, 0xD1342543DE82EF95, np.uint64)])


def groups(raws: list[bytes]) -> Iterator[list[bytes]]:
    """Neighbouring texts, SEGMENT bytes or a little more at a time."""
    group, size = [], 0
    for raw in raws:
        group.append(raw)
        size += len(raw)
        if size >= SEGMENT:
            yield group
            group, size = [], 0
    if group:
        yield group


def byte_runs(b: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of bytes of a class start and end; ``inside``: for each byte value, whether it is one."""
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = inside[b]
    edge = np.flatnonzero(own[1:] != own[:-1]) + 1
    if own[0]:
        edge = np.r_[0, edge]
    if own[-1]:
        edge = np.r_[edge, len(b)]
    return edge[::2], edge[1::2]


def spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a byte array start and end."""
    return byte_runs(b, _FILLED)


def hash_spans(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; spans must not overlap and none may be empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    inside = b[np.repeat(starts, size) + place]
    values = mix(inside.astype(np.uint64), 77)
    with np.errstate(over="ignore"):
        values *= _POWERS[place & (_STEP - 1)]
        if size.max() > _STEP:
            values *= mix((place // _STEP).astype(np.uint64), 5) | np.uint64(1)
        total = np.add.reduceat(values, np.cumsum(size) - size)
        return mix(total + size.astype(np.uint64), 3)


def word_table(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of several texts, and the first word of each text (and of the end)."""
    b = np.frombuffer(b"\n".join(raws), np.uint8)
    starts, ends = spans(b)
    step = 1 << 20  # words of a long text are hashed in strips
    hashes = [hash_spans(b, starts[a:a + step], ends[a:a + step]) for a in range(0, len(starts), step)]
    begins = np.cumsum([0, *(len(r) + 1 for r in raws)])
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.searchsorted(starts, begins)

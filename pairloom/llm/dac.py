"""Directly addressable codes for arrays of unsigned integers.

A value is cut into bytes, lowest first. Level 0 holds the lowest byte of every value, and
a bitmap that says which values continue; level 1 holds the next byte of those, and so on.
The place of a value on the next level is the number of set bits before it: a directory
with the count up to every 512th bit, plus the bits since. So any value is read from one
byte and one bit per level, without decoding its neighbours.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

RANK_BITS = 512


class Level(NamedTuple):
    """Bytes of one level; ``more`` and ``ranks`` are empty where no value continues."""

    chunks: bytes
    more: bytes
    ranks: bytes


def encode(values: np.ndarray) -> list[Level]:
    """Levels of the values; an empty array has one empty level."""
    rest, levels = np.asarray(values, np.uint32), []
    while True:
        chunks = (rest & 0xFF).astype(np.uint8).tobytes()
        goes_on = rest > 0xFF
        if not goes_on.any():
            levels.append(Level(chunks, b"", b""))
            return levels
        more = np.packbits(goes_on, bitorder="little")
        levels.append(Level(chunks, more.tobytes(), _rank_directory(more).tobytes()))
        rest = rest[goes_on] >> 8


def _rank_directory(more: np.ndarray) -> np.ndarray:
    width = RANK_BITS // 8
    padded = np.zeros(-(-len(more) // width) * width, np.uint8)
    padded[: len(more)] = more
    ones = np.bitwise_count(padded).reshape(-1, width).sum(axis=1, dtype=np.uint64)
    return np.concatenate(([0], np.cumsum(ones)[:-1])).astype("<u4")


def decode(levels: list[Level]) -> np.ndarray:
    """All values, level by level."""
    values = np.frombuffer(levels[0].chunks, np.uint8).astype(np.uint32)
    places = np.arange(len(values))
    for depth in range(1, len(levels)):
        more = np.frombuffer(levels[depth - 1].more, np.uint8)
        places = places[np.unpackbits(more, count=len(places), bitorder="little").view(bool)]
        values[places] |= np.frombuffer(levels[depth].chunks, np.uint8).astype(np.uint32) << (8 * depth)
    return values


def access(levels: list[Level], positions: np.ndarray) -> np.ndarray:
    """Values at the positions, by bitmaps and rank directories alone."""
    at = np.asarray(positions, np.int64)
    values, open_ = np.zeros(len(at), np.uint32), np.arange(len(at))
    for depth, level in enumerate(levels):
        values[open_] |= np.frombuffer(level.chunks, np.uint8)[at].astype(np.uint32) << (8 * depth)
        if not level.more:
            break
        more = np.frombuffer(level.more, np.uint8)
        goes_on = (more[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        open_, at = open_[goes_on], _rank(more, np.frombuffer(level.ranks, "<u4"), at[goes_on])
        if not len(at):
            break
    return values


def _rank(more: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Set bits before each position: the directory's count and at most 64 bytes."""
    first = at // RANK_BITS * (RANK_BITS // 8)
    window = first[:, None] + np.arange(RANK_BITS // 8)
    whole = np.where(window < (at >> 3)[:, None], more[np.minimum(window, len(more) - 1)], 0)
    last = more[at >> 3] & ((1 << (at & 7)) - 1).astype(np.uint8)
    since = np.bitwise_count(whole).sum(axis=1, dtype=np.int64) + np.bitwise_count(last)
    return ranks[at // RANK_BITS].astype(np.int64) + since

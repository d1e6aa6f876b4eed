"""Hashed word shingles of texts, vectorised over the bytes of a text."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

# Separators of words, and the letters that are lowered.
_SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

# Any odd 64-bit constants do.
_BASE = 0x9E3779B97F4A7C15
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_PLACES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_SLICE = 1 << 20
_LONG_WORD = 64

_IS_WORD = np.ones(256, bool)
_IS_WORD[list(_SEPARATORS)] = False


def mix(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that all bits depend on all."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(_MIX[0])
    values = (values ^ (values >> np.uint64(27))) * np.uint64(_MIX[1])
    return values ^ (values >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, for one slice."""
    tables = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        factors = np.full(_SLICE + 1, base, np.uint64)
        factors[0] = 1
        tables.append(np.cumprod(factors, dtype=np.uint64))
    return tables[0], tables[1]


def _slice_hashes(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IS_WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    powers, inverse = _powers()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(powers[: len(data)] * (data.astype(np.uint64) + np.uint64(1)), out=sums[1:])
    hashed = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    # A polynomial modulo a power of two has the same value for certain long words, whatever its base.
    for at in np.flatnonzero(ends - starts > _LONG_WORD):
        hashed[at] = _digest(raw[starts[at] : ends[at]])
    return hashed


def _digest(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def word_hashes(text: str) -> np.ndarray:
    """64-bit hash of each word, A-Z lowered. Long texts are hashed in slices cut between words."""
    raw = text.encode().translate(_LOWER)
    parts, at = [], 0
    while len(raw) - at > _SLICE:
        window = raw[at : at + _SLICE]
        cut = max(window.rfind(bytes([s])) for s in _SEPARATORS)
        if cut < 0:
            # One word longer than a slice: hash it by itself.
            end = min((p for s in _SEPARATORS if (p := raw.find(bytes([s]), at)) >= 0), default=len(raw))
            parts.append(np.array([_digest(raw[at:end])], np.uint64))
            at = end
        else:
            parts.append(_slice_hashes(window[:cut]))
            at += cut + 1
    parts.append(_slice_hashes(raw[at:]))
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words.

    Fewer words than that are one shingle, which no longer run equals; no words, none.
    """
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    if len(words) == 0:
        return words
    if len(words) < width:
        whole = mix(np.full(1, len(words), np.uint64) * np.uint64(_PLACES[0]))
        for at in range(len(words)):
            whole = mix(whole * np.uint64(_BASE) + words[at : at + 1])
        return whole
    runs = words[: len(words) - width + 1]
    for place in range(1, width):
        # Not symmetric in its operands: order matters.
        runs = mix(runs * np.uint64(_PLACES[place % 3])) + words[place : len(words) - width + 1 + place]
    return np.unique(mix(runs))


def set_digest(shingles: np.ndarray) -> bytes:
    """128 bits that stand for the whole set; none for an empty one."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()

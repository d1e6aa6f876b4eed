"""Splitting texts of Arrow columns into words, on whole batches at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def byte_table(spaces: bytes, breaks: bytes = b"") -> np.ndarray:
    """Byte to byte: A-Z lowered, ``spaces`` to a space, ``breaks`` to a line feed."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(spaces)] = 32
    table[list(breaks)] = 10
    return table


def translated(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """The texts with each byte replaced through ``table``; null is empty.

    Only bytes below 128 may change, so that the result is valid UTF-8 of the same lengths.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    if data is None:
        return texts
    changed = pa.py_buffer(table[np.frombuffer(data, np.uint8)])
    return pa.LargeStringArray.from_buffers(len(texts), offsets, changed, offset=texts.offset)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between spaces, and for each the number of the text it comes from."""
    lists = pc.split_pattern(texts, " ")
    words = lists.flatten()
    parents = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(words), 0)
    return words.filter(full), parents[full.to_numpy(zero_copy_only=False)]


def split_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces between line feeds, and for each the number of the text it comes from."""
    lists = pc.split_pattern(texts, "\n")
    return lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)


def numbered(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For each word the number of its text among the distinct ones, and these."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def hashes(words: Iterable[str]) -> np.ndarray:
    """64-bit hash of each text."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64)


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their first places and counts, and the rank of each key; lean in memory."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(starts, append=len(keys))
    ranks = np.empty(len(keys), np.int32)
    ranks[order] = np.repeat(np.arange(len(starts), dtype=np.int32), counts)
    return keys[starts], order[starts], counts, ranks


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of up to ``limit`` bytes of text; a longer text is a batch of its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(upto[at - 1]) if at else 0
            end = int(np.searchsorted(upto, before + limit - size, side="right"))
            if end <= at and not held:
                end = at + 1
            if end > at:
                held.append(batch.slice(at, end - at))
                size += int(upto[end - 1]) - before
                at = end
            if at < batch.num_rows:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def in_even_parts(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[list[pa.RecordBatch]]:
    """The rows again, as lists of batches of between half of ``limit`` and ``limit`` bytes of text.

    Only a longer text, or all rows where there is less, makes a part outside of that.
    """
    small = max(1, limit // 8)
    held: list[tuple[int, pa.RecordBatch]] = []
    size = 0

    def take(most: int) -> list[pa.RecordBatch]:
        nonlocal size
        part, taken = [], 0
        while held and (not part or taken + held[0][0] <= most):
            bytes_, batch = held.pop(0)
            part.append(batch)
            taken += bytes_
        size -= taken
        return part

    for batch in by_bytes(batches, column, small):
        bytes_ = pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        held.append((bytes_, batch))
        size += bytes_
        while size > limit + limit // 2:
            yield take(limit)
    if size > limit:
        yield take(size // 2)
    if held:
        yield take(size)

"""Encoding with public tokenizers inside tasks.

Tokenizer files are named, not shipped: a name is looked up on the worker with
``public_tokenizers.path``, anything else is taken as a path that every worker can read.
"""

from __future__ import annotations

import hashlib
import os
import string
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pairloom.llm.arrowwords import by_bytes

# Words kept per worker process, and the longest word that is kept.
CACHED_WORDS, CACHED_LENGTH = 800_000, 64

# Letters whose kind no version of Unicode has changed.
_LAST_LATIN = "\u024f"
_LATIN_LETTERS = [c for c in range(ord(_LAST_LATIN) + 1) if chr(c).isalpha()]

# All that is white space to the tokenizer's pattern, in front of a space.
_SPACE_BEFORE_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "

# Letters whose kind no version of Unicode has changed: those of Latin scripts up to _LAST_LATIN.
_LETTERS_ONLY = r"^[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+$"

# Bytes of text that are split into words at once.
ENCODED_BYTES = 8 << 20


def tokenizer_file(name: str) -> str:
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=None)
def tokenizer_digest(name: str) -> str:
    """Version of a tokenizer: digest of its file and of the library that runs it."""
    if name.endswith(".model"):
        from sentencepiece import __version__ as version
    else:
        from tokenizers import __version__ as version
    digest = hashlib.sha256(f"{os.path.basename(name)}|{version}|".encode())
    with open(tokenizer_file(name), "rb") as file:
        for block in iter(lambda: file.read(1 << 20), b""):
            digest.update(block)
    return digest.hexdigest()


@lru_cache(maxsize=None)
def _sentencepiece(name: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=tokenizer_file(name))


@lru_cache(maxsize=None)
def _tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file(name))


def count_tokens(name: str, texts: list[str]) -> list[int]:
    """Tokens of each text as the library counts them, without added special tokens."""
    if name.endswith(".model"):
        model = _sentencepiece(name)
        # One text at a time: the ids of a batch of long texts need not fit in memory together.
        return [len(model.encode(text)) for text in texts]
    words = _words(name)
    return [len(ids) // words.width for ids in words.encode(texts)]


class WordEncoder:
    """Ids of texts from a tokenizer, with the parts that come up again kept.

    A byte-level tokenizer splits a text before a space between two visible characters and
    encodes the parts by themselves, so a part met before needs no second call of the
    library. A part of plain letters, with or without punctuation behind, goes straight to
    the library's merge model; others go through the whole library. Texts with white space in front
    of a space, where a part could reach over it, are encoded whole, and so is every text
    of any other kind of tokenizer. Ids come as little-endian unsigned integers of ``width`` bytes.
    """

    def __init__(self, name: str):
        self.library = _tokenizer(name)
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        # Two generations: when the younger one is full, it becomes the older one, and words that are met move over.
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # First words of texts and punctuation behind words, which have no space in front.
        self.unspaced: dict[str, bytes] = {}
        self.by_words = self._splits_at_spaces()
        if self.by_words:
            # How the library writes the bytes of each Latin character for its merge model.
            split = self.library.pre_tokenizer
            self.written = {c: split.pre_tokenize_str(chr(c))[0][0] for c in (32, *_LATIN_LETTERS)}
            self.space = self.written[32]
            letter = "H" if self.width == 2 else "I"
            self.packs = [struct.Struct(f"<{n}{letter}").pack for n in range(CACHED_LENGTH + 2)]

    def _splits_at_spaces(self) -> bool:
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        split, model = self.library.pre_tokenizer, self.library.model
        return (
            isinstance(split, ByteLevel)
            and split.use_regex
            and not split.add_prefix_space
            and self.library.normalizer is None
            and isinstance(model, BPE)
            and not model.dropout
        )

    def _call(self, parts: list[str]) -> list[bytes]:
        # In slices: one call holds offsets and strings of all its tokens.
        coded = []
        for at in range(0, len(parts), 4096):
            batch = self.library.encode_batch_fast(parts[at : at + 4096], add_special_tokens=False)
            coded += [np.array(e.ids, self.dtype).tobytes() for e in batch]
        return coded

    def _unspaced(self, parts: list[str]) -> list[bytes]:
        """Ids of parts without a space in front; empty for an empty one."""
        known = self.unspaced
        missing = [part for part in parts if part and part not in known]
        found = dict(zip(missing, self._call(missing)))
        if len(known) + len(found) > CACHED_WORDS // 8:
            known.clear()
            found.update(zip(again := [p for p in parts if p and p not in found], self._call(again)))
        known.update((part, ids) for part, ids in found.items() if len(part) <= CACHED_LENGTH)
        return [found.get(part) or known.get(part, b"") for part in parts]

    def encode(self, texts: list[str]) -> list[bytes]:
        return [ids for part in self.encode_array(pa.array(texts, pa.string())) for ids in part]

    def encode_array(self, texts: pa.Array) -> Iterator[list[bytes]]:
        """Ids of each text of an Arrow column, null as empty, in lists of some megabytes of text."""
        for batch in by_bytes([pa.RecordBatch.from_arrays([texts], names=["text"])], "text", ENCODED_BYTES):
            part = pc.fill_null(batch.column(0).cast(pa.large_string()), "")
            if self.by_words:
                odd = pc.match_substring_regex(part, _SPACE_BEFORE_SPACE).to_numpy(zero_copy_only=False)
            else:
                odd = np.ones(len(part), bool)
            ids: list[bytes] = [b""] * len(part)
            whole = np.flatnonzero(odd)
            for at, coded in zip(whole, self._call(part.take(pa.array(whole)).to_pylist())):
                ids[at] = coded
            plain = np.flatnonzero(~odd)
            for at, coded in zip(plain, self._by_words(part.take(pa.array(plain)) if len(whole) else part)):
                ids[at] = coded
            yield ids

    def _by_words(self, texts: pa.Array) -> list[bytes]:
        """Split all texts at spaces, look up each distinct word once, and put the ids together by place."""
        if len(texts) == 0:
            return []
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        words = lists.flatten()
        # Every part but the first of a text carries its space, which is left out of the key.
        first = np.zeros(len(words), bool)
        first[offsets[:-1]] = True
        coded = words.filter(pa.array(~first)).dictionary_encode()
        heads = words.filter(pa.array(first)).dictionary_encode()
        pool, stem, rest = self._looked_up(coded.dictionary)
        # Two entries of the pool a word: the word, or its letters, and the punctuation behind them.
        which = np.zeros((len(words), 2), np.int32)
        of_word = coded.indices.to_numpy(zero_copy_only=False)
        which[~first, 0], which[~first, 1] = stem[of_word], rest[of_word]
        which[first, 0] = heads.indices.to_numpy(zero_copy_only=False) + len(pool)
        pool += self._unspaced(heads.dictionary.to_pylist())
        which = which.ravel()
        sizes = np.fromiter(map(len, pool), np.int32, len(pool)) // self.width
        values = np.frombuffer(b"".join(pool), self.dtype)
        starts = np.cumsum(sizes) - sizes
        per_entry = sizes[which]
        ends = np.cumsum(per_entry)
        # Place in the pool of each id: where its entry starts there, and how far into the entry it is.
        place = np.repeat(starts[which] - (ends - per_entry), per_entry)
        place += np.arange(len(place))
        data = values[place].tobytes()
        edges = (np.concatenate([[0], ends])[offsets * 2] * self.width).tolist()
        return [data[a:b] for a, b in zip(edges[:-1], edges[1:])]

    def _looked_up(self, words: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """A pool of ids, and for each distinct word behind a space its two entries there (0 is empty).

        Latin letters with or without punctuation behind them are two parts to the tokenizer: the
        letters go to the merge model, and are kept without what stands behind.
        """
        stems = pc.ascii_rtrim(words, string.punctuation)
        simple = pc.match_substring_regex(stems, _LETTERS_ONLY).to_numpy(zero_copy_only=False)
        simple &= pc.less_equal(pc.binary_length(words), CACHED_LENGTH).to_numpy(zero_copy_only=False)
        pool, stem, rest = [b""], np.zeros(len(words), np.int32), np.zeros(len(words), np.int32)
        letters = stems.filter(pa.array(simple)).dictionary_encode()
        stem[simple] = letters.indices.to_numpy(zero_copy_only=False) + len(pool)
        pool += self._ids_of(letters.dictionary.to_pylist(), self._merged)
        others = np.flatnonzero(~simple)
        stem[others] = np.arange(len(others)) + len(pool)
        pool += self._ids_of(words.take(pa.array(others)).to_pylist(), lambda parts: self._call([" " + p for p in parts]))
        lengths = pc.binary_length(stems).to_numpy(zero_copy_only=False)
        behind = np.flatnonzero(simple & (lengths < pc.binary_length(words).to_numpy(zero_copy_only=False)))
        marks: dict[str, int] = {}
        taken = pa.array(behind)
        for i, word, stem_ in zip(behind.tolist(), words.take(taken).to_pylist(), stems.take(taken).to_pylist()):
            mark = word[len(stem_) :]
            at = marks.get(mark)
            if at is None:
                at = marks[mark] = len(pool) + len(marks)
            rest[i] = at
        return pool + self._unspaced(list(marks)), stem, rest

    def _merged(self, stems: list[str]) -> list[bytes]:
        tokenize, packs = self.library.model.tokenize, self.packs
        coded = []
        for stem in stems:
            tokens = [t.id for t in tokenize(self.space + stem if stem.isascii() else (" " + stem).translate(self.written))]
            coded.append(packs[len(tokens)](*tokens))
        return coded

    def _ids_of(self, parts: list[str], encode) -> list[bytes]:
        """Ids of distinct parts, each behind a space, from those kept or by ``encode``."""
        known = self.parts
        found = [known.get(part) for part in parts]
        missing = [i for i, ids in enumerate(found) if ids is None]
        if not missing:
            return found
        if len(known) + len(missing) > CACHED_WORDS // 2:
            self.older, self.parts = known, {}
            known = self.parts
        older, new = self.older, []
        for i in missing:
            ids = older.get(parts[i])
            if ids is None:
                new.append(i)
            else:
                found[i] = known[parts[i]] = ids
        for i, ids in zip(new, encode([parts[i] for i in new])):
            found[i] = ids
            if len(parts[i]) <= CACHED_LENGTH:
                known[parts[i]] = ids
        return found


@lru_cache(maxsize=None)
def _words(name: str) -> WordEncoder:
    return WordEncoder(name)


def word_encoder(name: str) -> WordEncoder:
    """The worker's encoder for this tokenizer; its word cache is kept between tasks."""
    return _words(name)


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Texts of an Arrow column; null is empty."""
    return [text or "" for text in column.to_pylist()]

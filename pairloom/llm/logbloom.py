"""Language-model scores from a log-frequency Bloom filter.

Training texts give counts of words and of pairs (word before, word). A count's level is its
logarithm, rounded down; an n-gram of level q is put into the filter q times, as (n-gram, 1) to
(n-gram, q). Probing (n-gram, 1), (n-gram, 2), ... until one is missing gives the level
back, never too low, and hardly ever too high; the count is taken from the middle of the level.
The filter keeps no n-gram itself and goes to every worker.

The probability of a word after another is smoothed with as many imagined occurrences as ``prior`` says,
spread like single words: ``(c(h w) + prior p(w)) / (c(h) + prior)``, with
``p(w) = (c(w) + 1) / (N + V + 1)``.

The hash space is cut into buckets, more of them for more text, each a small filter of its own sized by
what it holds. Filters of pairs that are larger together than ``slice_bytes``, and of words beyond ``words_bytes``, are
sent in slices, one pass over the texts each; what one task or broadcast holds does not grow with the corpus, and
scores do not depend on the slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.arrowwords import by_bytes, byte_table, hashes, numbered, ranked, split_words, translated
from pairloom.llm.shingles import mix
from pairloom.llm.steps import written

# Fixed value: what separates words.
_TABLE = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")

# Bytes of text counted and scored at once.
LEARN_BYTES, SCORE_BYTES = 10 << 20, 6 << 20
# Text bytes that one bucket stands for.
BUCKET_TEXT = 2 << 20
BITS_EACH, PROBES, LEVEL_BASE = 10, 5, 1.5
LEAST_WORD, LEAST_PAIR = 1, 2
PRIOR = 500.0
SLICE_BYTES, WORDS_BYTES = 96 << 20, 96 << 20
# Words whose exact counts are sent to every task; the others' counts are joined.
HEADS = 1 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LEVEL, _SECOND = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
# A space is never inside a word.
_END, _START = hashes([" end", " start"])
_WORDS, _PAIRS = 0, 1

_REDUCED = "kind int, bucket bigint, least double, bits binary, entries bigint, total bigint, hashes binary, counts binary"


def _limits(least: int) -> np.ndarray:
    return least * LEVEL_BASE ** np.arange(110)


def levels_of(counts: np.ndarray, least: int) -> np.ndarray:
    """Level of each count: 0 below ``least``."""
    return np.searchsorted(_limits(least), counts, side="right")


def count_of_level(least: int) -> np.ndarray:
    """Mean of the whole numbers of each level; level 0 stands for 0."""
    limits = np.ceil(_limits(least))
    return np.concatenate([[0.0], (limits[:-1] + limits[1:] - 1) / 2])


def _bit_places(grams: np.ndarray, level: np.ndarray | int, n_bits: np.ndarray | int) -> Iterator[np.ndarray]:
    first = mix(grams + np.asarray(level, np.uint64) * _LEVEL)
    step = mix(first ^ _SECOND) | np.uint64(1)
    for probe in range(PROBES):
        yield (first + np.uint64(probe) * step) % np.asarray(n_bits, np.uint64)


def filled_bits(grams: np.ndarray, level: np.ndarray) -> bytes:
    """The filter of one bucket, sized by its entries."""
    unit = 8 << 6
    n_bits = -(-max(1, BITS_EACH * int(level.sum())) // unit) * unit
    bits = np.zeros(n_bits, bool)
    for at in range(1, int(level.max(initial=0)) + 1):
        for place in _bit_places(grams[level >= at], at, n_bits):
            bits[place] = True
    return np.packbits(bits, bitorder="little").tobytes()


class LogBloom:
    """Filters of some buckets, side by side."""

    def __init__(self, buckets: int, filters: dict[int, bytes], least: int):
        self.shift = np.uint64(64 - int(buckets).bit_length() + 1)
        self.whole = buckets == 1
        self.sizes, self.starts = np.zeros(buckets, np.uint64), np.zeros(buckets, np.uint64)
        at = 0
        for bucket, bits in sorted(filters.items()):
            self.sizes[bucket], self.starts[bucket] = len(bits) * 8, at
            at += len(bits)
        self.data = np.frombuffer(b"".join(bits for _, bits in sorted(filters.items())), np.uint8)
        self.count = count_of_level(least)
        self.own = self.sizes > 0

    def bucket(self, grams: np.ndarray) -> np.ndarray:
        return np.zeros(len(grams), np.int64) if self.whole else (grams >> self.shift).astype(np.int64)

    def counts(self, grams: np.ndarray) -> np.ndarray:
        """Count of each, from its level."""
        return self.count[self.levels(grams)]

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """Level of each by probing level after level; 0 where the first is missing."""
        level = np.zeros(len(grams), np.int64)
        open_ = np.flatnonzero(self.sizes[self.bucket(grams)])
        at = 0
        while len(open_):
            at += 1
            bucket = self.bucket(grams[open_])
            found = np.ones(len(open_), bool)
            for place in _bit_places(grams[open_], at, self.sizes[bucket]):
                byte = self.data[self.starts[bucket] + (place >> np.uint64(3))]
                found &= (byte >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
            open_ = open_[found]
            level[open_] = at
        return np.minimum(level, len(self.count) - 1)


class _Tokens:
    """All tokens of a batch: words and, after each text, its end; with the token before."""

    def __init__(self, texts: pa.Array):
        words, text_of = split_words(translated(texts, _TABLE))
        ids, distinct = numbered(words)
        n_texts = len(texts)
        per_text = np.bincount(text_of, minlength=n_texts) + 1
        self.ends = np.cumsum(per_text) - 1
        n = int(per_text.sum())
        self.text = np.repeat(np.arange(n_texts, dtype=np.int32), per_text)
        self.hash = np.concatenate([hashes(distinct.to_pylist()), [_END, _START]]).astype(np.uint64)
        self.end, self.start = len(distinct), len(distinct) + 1
        self.tokens = np.full(n, self.end, np.int32)
        inside = np.ones(n, bool)
        inside[self.ends] = False
        self.tokens[inside] = ids
        self.before = np.empty(n, np.int32)
        self.before[1:] = self.tokens[:-1]
        self.before[self.ends - per_text + 1] = self.start
        self.per_text = per_text

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First word, second word, count and place in the tokens of the distinct pairs."""
        width = self.start + 1
        keys, _, counts, ranks = ranked(self.before.astype(np.int64) * width + self.tokens)
        return keys // width, keys % width, counts, ranks


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _STEP + second)


# Sorted hashes and small counts, byte planes apart, so that the shuffle's compression finds the zeros.
def _planes(values: np.ndarray) -> bytes:
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _values(planes: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def _packed(kind: int, grams: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    order = np.argsort(grams)
    grams, counts = grams[order], counts[order].astype(np.int64)
    bucket = np.zeros(len(grams), np.int64) if buckets == 1 else (grams >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64)
    present, starts = np.unique(bucket, return_index=True)
    parts = list(zip(starts, [*starts[1:], len(grams)]))
    columns = [
        pa.array(np.full(len(present), kind, np.int32)),
        pa.array(present),
        pa.array([_planes(np.diff(grams[a:b], prepend=np.uint64(0))) for a, b in parts], pa.binary()),
        pa.array([_planes(counts[a:b]) for a, b in parts], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "bucket", "hashes", "counts"])


def _learned(buckets: int):
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", LEARN_BYTES):
            t = _Tokens(batch.column("text"))
            seen = np.bincount(t.tokens, minlength=t.start)
            # A batch may hold texts without words only: then the end alone.
            yield _packed(_WORDS, t.hash[: t.start][seen > 0], seen[seen > 0], buckets)
            first, second, counts, _ = t.pairs()
            yield _packed(_PAIRS, _pair_hash(t.hash[first], t.hash[second]), counts, buckets)

    return learn


def _reduced(group: pa.Table) -> pa.Table:
    """One bucket: its filter, and for words the exact counts."""
    kind, bucket = group.column("kind")[0].as_py(), group.column("bucket")[0].as_py()
    grams = np.concatenate([np.cumsum(_values(h, np.uint64), dtype=np.uint64) for h in group.column("hashes").to_pylist()])
    counts = np.concatenate([_values(c, np.int64) for c in group.column("counts").to_pylist()])
    distinct, inverse = np.unique(grams, return_inverse=True)
    summed = np.zeros(len(distinct), np.int64)
    np.add.at(summed, inverse, counts)
    least = LEAST_WORD if kind == _WORDS else LEAST_PAIR
    level = levels_of(summed, least)
    row = {
        "kind": [kind],
        "bucket": [bucket],
        "least": [float(least)],
        "bits": [filled_bits(distinct[level > 0], level[level > 0])],
        "entries": [len(distinct)],
        "total": [int(summed.sum())],
        "hashes": [distinct.tobytes() if kind == _WORDS else b""],
        "counts": [summed.tobytes() if kind == _WORDS else b""],
    }
    kinds = [pa.int32(), pa.int64(), pa.float64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.table([pa.array(v, k) for v, k in zip(row.values(), kinds)], names=list(row))


def _counted_words(low: int, high: int | None):
    """Words counted at least ``low`` and less than ``high`` times."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c in zip(batch.column("hashes").to_pylist(), batch.column("counts").to_pylist()):
                h, c = np.frombuffer(h, np.int64), np.frombuffer(c, np.int64)
                keep = (c >= low) if high is None else (c >= low) & (c < high)
                yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(c[keep])], names=["word", "c"])

    return unpack


def _head_limit(words: DataFrame, heads: int) -> int:
    """Smallest power of two such that at most ``heads`` words are counted as often."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(64, np.int64)
        for batch in batches:
            for c in batch.column("counts").to_pylist():
                powers = np.log2(np.frombuffer(c, np.int64)).astype(np.int64)
                held += np.bincount(powers, minlength=64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(64)), pa.array(held)], names=["power", "n"])

    found = words.select("counts").mapInArrow(sizes, "power bigint, n bigint").groupBy("power").agg(F.sum("n").alias("n"))
    n = {row["power"]: row["n"] for row in found.collect()}
    upto, power = 0, 63
    while power >= 0 and upto + n.get(power, 0) <= heads:
        upto += n.get(power, 0)
        power -= 1
    return 1 << (power + 1)


_SCORED = (
    "row bigint, n_tokens bigint, n_known bigint, base_score double, score double, "
    "word bigint, rows array<bigint>, times array<bigint>"
)


def _empty(kind: pa.DataType, n: int) -> pa.Array:
    return pa.nulls(n, kind)


def _levelled(words):
    """Add to ``levels``, a byte a token of each text, those of the words this slice holds."""

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single = words.value
        for batch in by_bytes(batches, "text", SCORE_BYTES):
            t = _Tokens(batch.column("text"))
            found = single.levels(t.hash[: t.start]).astype(np.uint8)[t.tokens]
            # A word is in one slice only; before the first there are no levels.
            if batch.column("levels").null_count == 0:
                found = np.maximum(found, _bytes_of(batch.column("levels")))
            ends = t.ends + 1
            levels = pa.array([found[end - n : end].tobytes() for end, n in zip(ends, t.per_text)], pa.binary())
            at = batch.schema.get_field_index("levels")
            yield batch.set_column(at, "levels", levels)

    return level


def _bytes_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8)


def _scored(words, heads, pairs, texts_learned: int, total: int, vocabulary: int, prior: float, first: bool):
    """Sums of each text over the pairs this slice holds; in the first round also base and known words.

    Words whose exact count is not at hand follow as rows of their own: the word and where it occurs.
    """
    per = float(total + vocabulary + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, double = None if words is None else words.value, pairs.value
        head_words, head_counts, complete = heads.value
        for batch in by_bytes(batches, "text", SCORE_BYTES):
            rows = batch.column("row").to_numpy(zero_copy_only=False)
            t = _Tokens(batch.column("text"))
            if single is not None:
                guessed = single.counts(t.hash)
            else:
                guessed = np.zeros(len(t.hash))
                guessed[t.tokens] = count_of_level(LEAST_WORD)[_bytes_of(batch.column("levels"))]
            guessed[t.start] = texts_learned
            a, b, _, inverse = t.pairs()
            grams = _pair_hash(t.hash[a], t.hash[b])
            held = double.own[double.bucket(grams)]
            history = guessed[a]
            both = np.minimum(double.counts(grams), history)
            lower = (guessed[b] + 1.0) / per
            chance = np.log10((both + prior * lower) / (history + prior))
            total_score = np.bincount(t.text, weights=np.where(held, chance, 0.0)[inverse], minlength=len(rows))
            n = len(rows)
            if not first:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows), *[_empty(pa.int64(), n)] * 2, _empty(pa.float64(), n), pa.array(total_score),
                        _empty(pa.int64(), n), *[_empty(pa.list_(pa.int64()), n)] * 2,
                    ],
                    names=[c.split()[0] for c in _SCORED.split(", ")],
                )
                continue
            # Exact counts: -1 where only the join can tell.
            at = np.minimum(np.searchsorted(head_words, t.hash[: t.start]), max(0, len(head_words) - 1))
            exact = np.full(t.start, 0 if complete else -1, np.int64)
            exact[guessed[: t.start] == 0] = 0
            if len(head_words):
                hit = head_words[at] == t.hash[: t.start]
                exact[hit] = head_counts[at[hit]]
            log = np.where(exact >= 0, np.log10((np.maximum(exact, 0) + 1.0) / per), 0.0)
            base = np.bincount(t.text, weights=log[t.tokens], minlength=n)
            known = np.bincount(t.text, weights=(exact > 0)[t.tokens], minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows), pa.array(t.per_text), pa.array(known), pa.array(base), pa.array(total_score),
                    _empty(pa.int64(), n), *[_empty(pa.list_(pa.int64()), n)] * 2,
                ],
                names=[c.split()[0] for c in _SCORED.split(", ")],
            )
            open_ = np.flatnonzero(exact[t.tokens] < 0)
            keys, times = np.unique(t.tokens[open_].astype(np.int64) * n + t.text[open_], return_counts=True)
            found, starts = np.unique(keys // n, return_index=True)
            offsets = pa.array(np.append(starts, len(keys)).astype(np.int32))
            m = len(found)
            yield pa.RecordBatch.from_arrays(
                [
                    _empty(pa.int64(), m), *[_empty(pa.int64(), m)] * 2, *[_empty(pa.float64(), m)] * 2,
                    pa.array(t.hash[found].view(np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array(rows[keys % n])),
                    pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64))),
                ],
                names=[c.split()[0] for c in _SCORED.split(", ")],
            )

    return score


def _slices(sizes: list[tuple[int, int]], limit: int) -> list[tuple[int, int]]:
    """First and last bucket of runs of at most ``limit`` bytes."""
    runs: list[tuple[int, int]] = []
    held = limit
    for bucket, size in sizes:
        if held + size > limit:
            runs.append((bucket, bucket))
            held = 0
        runs[-1] = (runs[-1][0], bucket)
        held += size
    return runs or [(0, 0)]


def language_scores(
    df: DataFrame,
    doc_id: str,
    text: str,
    held_out: Column,
    prior: float = PRIOR,
    heads: int = HEADS,
    slice_bytes: int = SLICE_BYTES,
    words_bytes: int = WORDS_BYTES,
) -> DataFrame:
    """Log10 probability of every text, learned from those that are not ``held_out``.

    Tokens are words between spaces, tabs and line ends, A-Z lowered, and one end a text. One row a text:
    ``doc_id``, ``held_out``, ``n_tokens``, ``n_known`` (tokens seen in training), ``train_tokens``, ``base_score`` (each
    token by its exact count plus one) and ``score`` (the filter's).

    A null text is empty and has its end only; a null ``held_out`` counts as false; null or repeated ids
    are rows of their own; other columns are not used. Without training texts every token has the same chance.
    An empty table gives an empty result.
    """
    spark = df.sparkSession
    docs = df.select(
        F.col(doc_id).alias("id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("out"),
    )
    learning = docs.filter(~F.col("out"))
    known = learning.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count("*").alias("texts")).first()
    buckets = 1
    while buckets * BUCKET_TEXT < (known["bytes"] or 0):
        buckets *= 2
    learned = learning.select("text").mapInArrow(_learned(buckets), "kind int, bucket bigint, hashes binary, counts binary")
    model = written(learned.groupBy("kind", "bucket").applyInArrow(_reduced, _REDUCED), "model")
    words, pairs = model.filter(F.col("kind") == _WORDS), model.filter(F.col("kind") == _PAIRS)
    stats = words.agg(F.sum("total").alias("total"), F.sum("entries").alias("entries")).first()
    total, vocabulary = stats["total"] or 0, stats["entries"] or 0

    limit = _head_limit(words, heads)
    # At most ``heads`` rows.
    top = words.select("hashes", "counts").mapInArrow(_counted_words(limit, None), "word bigint, c bigint").toArrow()
    head_words, head_counts = top.column("word").to_numpy().view(np.uint64), top.column("c").to_numpy()
    order = np.argsort(head_words)
    complete = limit == 1
    context = spark.sparkContext
    sent_heads = context.broadcast((head_words[order], head_counts[order], complete))
    word_slices, slices = _slices(_sizes(words), words_bytes), _slices(_sizes(pairs), slice_bytes)
    texts = docs.withColumn("row", F.monotonically_increasing_id())
    if len(slices) > 1 or len(word_slices) > 1:
        # The row numbers must hold over several passes.
        texts = written(texts, "texts")
    numbers, sent_words = [], None
    if len(word_slices) == 1:
        sent_words = context.broadcast(LogBloom(buckets, _filters(words), LEAST_WORD))
    else:
        # The levels of words, slice after slice: the same as from one filter of all words.
        texts, numbers = texts.withColumn("levels", F.lit(None).cast("binary")), ["levels"]
        for group in word_slices:
            held = context.broadcast(LogBloom(buckets, _filters(words.filter(F.col("bucket").between(*group))), LEAST_WORD))
            texts = written(texts.mapInArrow(_levelled(held), texts.schema), "levels")
            held.unpersist()
    rounds: list[DataFrame] = []
    for nr, group in enumerate(slices):
        double = LogBloom(buckets, _filters(pairs.filter(F.col("bucket").between(*group))), LEAST_PAIR)
        # Pairs of buckets that hold nothing are the first slice's.
        double.own = np.ones(buckets, bool)
        for other in slices[:nr] + slices[nr + 1 :]:
            double.own[other[0] : other[1] + 1] = False
        if nr:
            double.own &= double.sizes > 0
        sent = context.broadcast(double)
        scoring = _scored(sent_words, sent_heads, sent, known["texts"], total, vocabulary, prior, nr == 0)
        if nr == 0:
            ids = f"id {df.schema[doc_id].dataType.simpleString()}, out boolean"
            rounds.append(written(texts.mapInArrow(_with_ids(scoring), f"{_SCORED}, {ids}"), "scores"))
        else:
            part = texts.select("row", "text", *numbers).mapInArrow(scoring, _SCORED)
            rounds.append(written(part.select("row", "score"), "scores"))
        sent.unpersist()
    scored = rounds[0]
    if len(rounds) > 1:
        more = reduce(DataFrame.unionByName, rounds[1:]).groupBy("row").agg(F.sum("score").alias("more"))
        scored = scored.join(more, "row", "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0)))

    results = scored.filter(F.col("word").isNull())
    if not complete:
        rest = words.select("hashes", "counts").mapInArrow(_counted_words(1, limit), "word bigint, c bigint")
        places = scored.filter(F.col("word").isNotNull()).select("word", "rows", "times").join(rest, "word", "left")
        places = places.select(
            F.coalesce("c", F.lit(0)).alias("c"), F.explode(F.arrays_zip("rows", "times")).alias("at")
        ).select(F.col("at.rows").alias("row"), F.col("at.times").alias("times"), "c")
        log = F.log10((F.col("c") + 1.0) / F.lit(float(total + vocabulary + 1)))
        extra = places.groupBy("row").agg(
            F.sum(F.col("times") * log).alias("base_more"),
            F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known_more"),
        )
        results = results.join(extra, "row", "left").withColumns(
            {
                "base_score": F.col("base_score") + F.coalesce("base_more", F.lit(0.0)),
                "n_known": F.col("n_known") + F.coalesce("known_more", F.lit(0)),
            }
        )
    return results.select(
        F.col("id").alias(doc_id), F.col("out").alias("held_out"), "n_tokens", "n_known",
        F.lit(total).cast("long").alias("train_tokens"), "base_score", "score",
    )


def _with_ids(scoring):
    """Give results the id and flag of their text, in one pass."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SCORE_BYTES):
            for at, part in enumerate(scoring(iter([batch]))):
                columns = [part.column(i) for i in range(part.num_columns)]
                same = at == 0
                ids = batch.column("id") if same else pa.nulls(part.num_rows, batch.schema.field("id").type)
                out = batch.column("out") if same else pa.nulls(part.num_rows, pa.bool_())
                yield pa.RecordBatch.from_arrays([*columns, ids, out], names=[*part.schema.names, "id", "out"])

    return score


def _sizes(model: DataFrame) -> list[tuple[int, int]]:
    return [(r["bucket"], r["size"]) for r in model.select("bucket", F.length("bits").alias("size")).orderBy("bucket").collect()]


def _filters(model: DataFrame) -> dict[int, bytes]:
    """Filters by bucket."""
    return {row["bucket"]: row["bits"] for row in model.select("bucket", "bits").toLocalIterator()}

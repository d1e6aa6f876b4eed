"""Phrase collocations by partitioned mining of frequent phrases.

The corpus is cut into shards. A phrase that occurs ``least`` times in all occurs in one shard at
least as often as that shard's share of the bytes asks for. So each shard is mined completely, in
memory, at its proportional support; the phrases frequent somewhere are united; and a second
pass counts every one of them over the whole corpus, exactly. Shards are as large as
a task's memory allows: below a hundredth of the corpus (for ``least`` = 100) the local support reaches one
and only the second pass still removes anything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.llm.arrowwords import by_bytes, byte_table, hashes, in_even_parts, numbered, ranked, split_pieces, split_words, translated
from pairloom.llm.shingles import mix
from pairloom.llm.steps import written

# Characters that end a piece, and those between words.
_BREAKS, _SPACES = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
_TABLE = byte_table(_SPACES, _BREAKS)

# Bytes of text mined at once; the tasks that the corpus is dealt to for mining. Counting takes less at once.
SHARD_BYTES, SHARDS = 32 << 20, 36
COUNT_BYTES = 8 << 20
# Counted phrases that a task holds at most before it hands them on.
HELD_ROWS = 1 << 20
# Largest bitmap of candidates, in bits; what collides in it is counted in vain, no phrase is lost.
MOST_BITS = 1 << 27
_BITS_EACH = 32
# Phrases are packed, and united, by the first bits of their hashes: into this many buckets, or more for large corpora.
_LEAST_BUCKETS, _BUCKET_BYTES = 1 << 10, 64 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _levels(
    keys: np.ndarray,
    hash_of: Callable[[np.ndarray], np.ndarray],
    piece: np.ndarray,
    longest: int,
    keep: Callable[[np.ndarray, np.ndarray], np.ndarray],
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Length, first places, hashes and counts of the phrases that ``keep`` chooses by hash and count.

    ``keys`` tell words (of a group) apart, place by place; ``piece`` says which may stand in one phrase. A longer
    phrase is looked at where both its parts without one end word were kept.
    """
    n = len(keys)
    places = np.arange(n, dtype=np.int32)
    for length in range(1, longest + 1):
        if length > 1:
            last = n - length + 1
            if last <= 0:
                return
            open_ = (piece[:last] == piece[length - 1 :]) & (grams[:last] >= 0) & (grams[1 : last + 1] >= 0)
            places = np.flatnonzero(open_).astype(np.int32)
            keys = grams[places].astype(np.int64) * singles + base[places + (length - 1)]
        if len(places) == 0:
            return
        distinct, first, counts, ranks = ranked(keys)
        h = hash_of(distinct) if length == 1 else mix(prefix_hash[distinct // singles] * _STEP + single_hash[distinct % singles])
        kept = keep(h, counts)
        dense = np.where(kept, np.cumsum(kept) - 1, -1).astype(np.int32)
        grams = np.full(n, -1, np.int32)
        grams[places] = dense[ranks]
        prefix_hash = h[kept]
        if length == 1:
            base, singles, single_hash = grams, max(1, len(prefix_hash)), prefix_hash
        yield length, places[first[kept]], prefix_hash, counts[kept]


_MINED = "bucket bigint, slack bigint, phrases binary, above binary"


class _Words:
    """Words of a batch in order: number and piece of each, group of each piece."""

    def __init__(self, batch: pa.RecordBatch):
        pieces, text_of = split_pieces(translated(batch.column("text"), _TABLE))
        words, piece = split_words(pieces)
        self.piece = piece.astype(np.int32)
        self.words, self.texts = numbered(words)
        groups = batch.column("lang").dictionary_encode()
        self.groups = groups.dictionary.to_pylist()
        self.group = groups.indices.to_numpy(zero_copy_only=False)[text_of]
        self.word_hash = hashes(self.texts.to_pylist())
        self.group_hash = hashes(self.groups)

    def totals(self) -> np.ndarray:
        return np.bincount(self.group[self.piece], minlength=len(self.groups))

    def hashed(self) -> np.ndarray:
        """Hash of group and word at each place."""
        return mix(self.group_hash[self.group][self.piece] * _STEP + self.word_hash[self.words])

    def levels(self, longest: int, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        vocabulary = max(1, len(self.texts))
        keys = self.group[self.piece].astype(np.int64) * vocabulary + self.words
        return _levels(
            keys, lambda k: mix(self.group_hash[k // vocabulary] * _STEP + self.word_hash[k % vocabulary]), self.piece, longest, keep
        )

    def phrases(self, first: np.ndarray, length: int) -> pa.Array:
        parts = [self.texts.take(pa.array(self.words[first + i])) for i in range(length)]
        if length == 1:
            return parts[0].cast(pa.string())
        return pc.binary_join_element_wise(*parts, pa.scalar(" ", parts[0].type)).cast(pa.string())


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64)


def _mined(total: int, least: int, longest: int, shard_bytes: int, buckets: int):
    """Per shard: its support less one; and each locally frequent phrase's count above that, packed by bucket.

    Words are hashes here, so that a shard is a few numbers a word; two words of one hash only add a candidate.
    """

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in in_even_parts(batches, "text", shard_bytes):
            share, words, pieces, n_pieces = 0, [], [], 0
            for batch in shard:
                share += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
                part = _Words(batch)
                words.append(part.hashed().view(np.int64))
                pieces.append(part.piece + np.int32(n_pieces))
                n_pieces += len(part.group)
            support = max(1, -(-least * share // max(1, total)))
            yield _packed([None], [support - 1], [b""], [b""])
            keys, piece = np.concatenate(words), np.concatenate(pieces)
            del words, pieces, part, batch, shard
            pa.default_memory_pool().release_unused()
            for _, _, h, counts in _levels(keys, lambda k: k.view(np.uint64), piece, longest, lambda _, counts: counts >= support):
                order = np.argsort(h)
                h, above = h[order], (counts[order] - (support - 1)).astype(np.int32)
                present, starts = np.unique(_bucket(h, buckets), return_index=True)
                parts = list(zip(starts, [*starts[1:], len(h)]))
                yield _packed(present, [0] * len(parts), [h[a:b].tobytes() for a, b in parts], [above[a:b].tobytes() for a, b in parts])

    return mine


def _packed(buckets, slack, phrases, above) -> pa.RecordBatch:
    columns = [pa.array(buckets, pa.int64()), pa.array(slack, pa.int64()), pa.array(phrases, pa.binary()), pa.array(above, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "slack", "phrases", "above"])


def _possible(least: int, slack: int):
    """The phrases of one bucket that can reach ``least``: a shard that does not name one holds less than its support."""

    def unite(group: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(p, np.uint64) for p in group.column("phrases").to_pylist()])
        above = np.concatenate([np.frombuffer(a, np.int32) for a in group.column("above").to_pylist()])
        order = np.argsort(h)
        h, above = h[order], above[order]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        possible = h[starts][np.add.reduceat(above.astype(np.int64), starts) + slack >= least]
        row = [[group.column("bucket")[0].as_py()], [len(possible)], [possible.tobytes()]]
        return pa.table([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.binary()))], names=["bucket", "n", "phrases"])

    return unite


def _places(h: np.ndarray, region: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of a phrase inside the region of its bucket."""
    low = np.uint64(region - 1)
    return h & low, (h >> np.uint64(24)) & low


def _regions(region: int):
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            filled = []
            for phrases in batch.column("phrases").to_pylist():
                bits = np.zeros(region, bool)
                for place in _places(np.frombuffer(phrases, np.uint64), region):
                    bits[place] = True
                filled.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), pa.array(filled, pa.binary())], names=["bucket", "bits"])

    return fill


def _candidates(mined: DataFrame, least: int, buckets: int) -> np.ndarray:
    """Bitmap of all phrases that can reach ``least``, a region of it per bucket."""
    slack = mined.agg(F.sum("slack")).first()[0] or 0
    named = mined.filter(F.col("bucket").isNotNull()).select("bucket", "phrases", "above")
    united = named.groupBy("bucket").applyInArrow(_possible(least, slack), "bucket bigint, n bigint, phrases binary")
    united = written(united, "phrases")
    wanted = _BITS_EACH * (united.agg(F.sum("n")).first()[0] or 0)
    region = 64
    while region * buckets < min(MOST_BITS, wanted):
        region *= 2
    bitmap = np.zeros((buckets, region // 8), np.uint8)
    # At most MOST_BITS / 8 bytes, whatever the corpus.
    for row in united.select("bucket", "phrases").mapInArrow(_regions(region), "bucket bigint, bits binary").toLocalIterator():
        bitmap[row["bucket"]] = np.frombuffer(row["bits"], np.uint8)
    return bitmap


def _counted(bitmap, longest: int):
    """How often the possible phrases occur, summed by task and packed by bucket; and the words of each group."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        buckets = len(bits)

        def known(h: np.ndarray, _: np.ndarray) -> np.ndarray:
            found = np.ones(len(h), bool)
            for place in _places(h, bits.shape[1] * 8):
                byte = bits[_bucket(h, buckets), place >> np.uint64(3)]
                found &= (byte >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
            return found

        held: list[pa.Table] = []
        for batch in by_bytes(batches, "text", COUNT_BYTES):
            words = _Words(batch)
            names = pa.array(words.groups, pa.string())
            none = pa.nulls(len(names), pa.string())
            held.append(_phrases(np.zeros(len(names), np.int64), names, none, 0, words.totals()))
            for length, first, h, counts in words.levels(longest, known):
                group = names.take(pa.array(words.group[words.piece[first]]))
                held.append(_phrases(_bucket(h, buckets), group, words.phrases(first, length), length, counts))
            if sum(part.num_rows for part in held) > HELD_ROWS:
                held = [_summed(held)]
                if held[0].num_rows > HELD_ROWS // 2:
                    yield _listed(held.pop())
        if held:
            yield _listed(_summed(held))

    return count


_KEYS = ["bucket", "lang", "phrase", "length"]
_LISTED = "bucket bigint, langs array<string>, phrases array<string>, lengths array<int>, counts array<bigint>"
_COUNTS = "lang string, phrase string, length int, a bigint"


def _phrases(bucket: np.ndarray, lang: pa.Array, phrase: pa.Array, length: int, counts: np.ndarray) -> pa.Table:
    lengths = pa.array(np.full(len(counts), length, np.int32))
    return pa.table([pa.array(bucket), lang, phrase, lengths, pa.array(counts.astype(np.int64))], names=[*_KEYS, "a"])


def _summed(parts: list[pa.Table]) -> pa.Table:
    summed = pa.concat_tables(parts).group_by(_KEYS).aggregate([("a", "sum")])
    return summed.rename_columns([*_KEYS, "a"])


def _listed(table: pa.Table) -> pa.RecordBatch:
    """One row a bucket."""
    table = table.take(pc.sort_indices(table, [("bucket", "ascending")])).combine_chunks()
    buckets, starts = np.unique(table.column("bucket").to_numpy(), return_index=True)
    offsets = pa.array(np.append(starts, table.num_rows).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, table.column(c).combine_chunks()) for c in ("lang", "phrase", "length", "a")]
    return pa.RecordBatch.from_arrays([pa.array(buckets), *lists], names=["bucket", "langs", "phrases", "lengths", "counts"])


def _added(least: int):
    """The phrases of one bucket with their sums over all tasks, as far as they are frequent."""

    def add(group: pa.Table) -> pa.Table:
        columns = [group.column(c).combine_chunks().flatten() for c in ("langs", "phrases", "lengths", "counts")]
        table = pa.table(columns, names=["lang", "phrase", "length", "a"])
        summed = table.group_by(["lang", "phrase", "length"]).aggregate([("a", "sum")]).rename_columns(table.column_names)
        return summed.filter(pc.or_(pc.greater_equal(summed.column("a"), least), pc.equal(summed.column("length"), 0)))

    return add


def phrase_counts(df: DataFrame, text: str, lang: str, least: int = 100, longest: int = 5, shards: int = SHARDS) -> DataFrame:
    """Exact counts of all phrases of 1 to ``longest`` words that occur ``least`` times in their language.

    ``lang``, ``phrase`` (words joined by a space), ``length`` and ``a``; and one row a language
    with a null phrase, length 0 and the number of all its words. Occurrences overlap; none spans two pieces.
    """
    spark = df.sparkSession
    docs = df.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = _LEAST_BUCKETS
    while buckets * _BUCKET_BYTES < total:
        buckets *= 2
    # Fewer and larger shards by reading several splits in one task: no shuffle.
    mining = docs.coalesce(shards).mapInArrow(_mined(total, least, longest, SHARD_BYTES, buckets), _MINED)
    bitmap = spark.sparkContext.broadcast(_candidates(written(mining, "mined"), least, buckets))
    counted = docs.mapInArrow(_counted(bitmap, longest), _LISTED)
    return written(counted.groupBy("bucket").applyInArrow(_added(least), _COUNTS), "counts")


def _part(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(
    df: DataFrame, text: str, lang: str, least: int = 100, longest: int = 5, top: int = 2000, shards: int = SHARDS
) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``longest`` words by how much more often they occur than chance.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and those into words at
    spaces and tabs. For a cut of a phrase with ``a`` occurrences into parts with ``l`` and ``r``,
    out of ``n`` words: ``floor(1000 a n / (l r))``; the lowest cut counts, ties to the earliest. Phrases inside a longer
    one that is as frequent are left out. Order: score, a (descending), phrase (bytes).

    A null text is empty; a null language is ``und``. Repeated rows and null or repeated ids count
    as rows of their own; other columns are not used. An empty table, or one without a frequent phrase, gives no rows.
    """
    counts = phrase_counts(df, text, lang, least, longest, shards)
    totals = counts.filter(F.col("phrase").isNull()).select("lang", F.col("a").alias("n"))
    known = counts.filter(F.col("phrase").isNotNull())
    words = F.split("phrase", " ", -1)
    candidates = known.filter(F.col("length") >= 2).withColumn("words", words)

    cuts = candidates.select(
        "lang", "phrase", "length", "a", "words", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k")
    ).select(
        "lang", "phrase", "length", "a", "k",
        _part(F.col("words"), F.lit(1), F.col("k")).alias("first"),
        _part(F.col("words"), F.col("k") + 1, F.col("length") - F.col("k")).alias("rest"),
    )
    left = known.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    # A language is one row there; there are far fewer of them than phrases.
    priced = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    # Up to 38 digits: counts below 2 ** 41 cannot overflow.
    score = F.expr("cast((cast(1000 as decimal(38,0)) * a * n) div (cast(l as decimal(38,0)) * r) as bigint)")
    best = (
        priced.select("lang", "phrase", "length", "a", "n", "k", "l", "r", score.alias("score"))
        .groupBy("lang", "phrase", "length", "a", "n")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )

    # Every shorter run of at least two words inside a candidate, with the largest count around it.
    inner = candidates.filter(F.col("length") > 2).select(
        "lang", "a", "words", "length", F.explode(F.sequence(F.lit(2), F.col("length") - 1)).alias("size")
    )
    inner = inner.select(
        "lang", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("size") + 1)).alias("start")
    ).select("lang", _part(F.col("words"), F.col("start"), F.col("size")).alias("phrase"), F.col("a").alias("around"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    kept = best.join(covered, ["lang", "phrase"], "left").filter(F.col("around").isNull() | (F.col("around") < F.col("a")))

    flat = kept.select(
        "lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")
    )
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # First inside slices of a language, so that a hot one does not meet in one task whole.
    slices = flat.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    near = slices.withColumn("rank", F.row_number().over(W.partitionBy("lang", "slice").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = near.drop("slice").withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

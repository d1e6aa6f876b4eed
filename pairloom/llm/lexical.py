"""Ranked lexical search by pipelined term partitioning.

Terms of the queries are dealt to a few owners, the rarest to the first. Items travel in bundles, and a bundle
in parts, one per block of documents: sparse accumulators of (item, document, score). Each
stage brings every part together with its owner's postings of the same block by cogroup, adds the
owner's integer contributions, and passes on the accumulators. After a stage the tenth best score so far
of an item bounds its last place from below; accumulators that cannot reach it any more, even
with all that later owners could add, are left behind. The last stage hands over each block's best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.llm.arrowwords import by_bytes, byte_table, split_words, translated
from pairloom.llm.steps import written
from pairloom.operators.timeline import running_sum

# Characters between terms, and the pattern of a term.
_BETWEEN = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TABLE = byte_table(_BETWEEN)
_TABLE[10] = 32

OWNERS = 4
BLOCK_DOCS, BLOCK_BYTES = 2048, 16 << 20
BUNDLE = 256
# Pairs of item and term that one run of the stages takes at most, but for a single larger item.
RUN_PAIRS = 1 << 20
# Contributions stay below this weight times a million; sums below 2 ** 53 are exact in doubles.
_MOST_PART, _EXACT = 1_000_000, 1 << 53

_INDEX = (
    "block bigint, docs array<bigint>, lengths binary, terms binary, runs binary, slots binary, times binary, "
    "n_docs bigint, n_terms bigint"
)
_STATE = "bundle int, block bigint, items binary, slots binary, scores binary, best binary, docs array<bigint>"


def _indexed(vocabulary, block_docs: int):
    """Postings of blocks of documents for the terms of the queries, sorted by term, and lengths of all documents."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = vocabulary.value
        block = TaskContext.get().partitionId() << 32
        for large in by_bytes(batches, "text", BLOCK_BYTES):
            for start in range(0, large.num_rows, block_docs):
                batch = large.slice(start, block_docs)
                words, doc = split_words(translated(batch.column("text"), _TABLE))
                lengths = np.bincount(doc, minlength=batch.num_rows).astype(np.int64)
                known = pc.index_in(words, value_set=terms)
                valid = known.is_valid().to_numpy(zero_copy_only=False)
                term = known.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
                keys, times = np.unique(term * batch.num_rows + doc[valid], return_counts=True)
                distinct, runs = np.unique(keys // batch.num_rows, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block]),
                        pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("id")),
                        pa.array([lengths.tobytes()], pa.binary()),
                        pa.array([distinct.astype(np.int32).tobytes()], pa.binary()),
                        pa.array([runs.astype(np.int32).tobytes()], pa.binary()),
                        pa.array([(keys % batch.num_rows).astype(np.uint16).tobytes()], pa.binary()),
                        pa.array([times.astype(np.int32).tobytes()], pa.binary()),
                        pa.array([int((lengths > 0).sum())]),
                        pa.array([int(lengths.sum())]),
                    ],
                    names=[c.split()[0] for c in _INDEX.split(", ")],
                )
                block += 1

    return index


def _frequencies(size: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            for terms, runs in zip(batch.column("terms").to_pylist(), batch.column("runs").to_pylist()):
                held[np.frombuffer(terms, np.int32)] += np.frombuffer(runs, np.int32)
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(held[found])], names=["term", "df"])

    return add


class _Plan:
    """What the stages of one run share: weights, owners, and which items of a bundle use which term."""

    def __init__(self, item: np.ndarray, term: np.ndarray, repeats: np.ndarray, df: np.ndarray, n_docs: int, n_terms: int, owners: int, k: int):
        self.n_docs, self.n_terms, self.k, self.stages, self.bundle = n_docs, n_terms, k, owners, BUNDLE
        self.items = int(item.max(initial=-1)) + 1
        self.weight = np.array([int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * int(x) + 1)))) for x in df], np.int64)
        order = np.argsort(df, kind="stable")
        # Rare terms first; each owner has as many postings.
        upto = np.cumsum(df[order])
        self.owner = np.zeros(len(df), np.int64)
        self.owner[order] = np.minimum(owners - 1, upto * owners // max(1, int(upto[-1]) if len(upto) else 1))
        self.uses = {}
        for bundle in range(-(-self.items // BUNDLE)):
            inside = item // BUNDLE == bundle
            by_term = np.argsort(term[inside], kind="stable")
            self.uses[bundle] = (term[inside][by_term], item[inside][by_term] % BUNDLE, repeats[inside][by_term])
        # What each item can still gain after each stage.
        most = self.weight[term] * _MOST_PART * repeats
        self.later = np.zeros((owners, self.items), np.int64)
        for stage in range(owners):
            beyond = self.owner[term] > stage
            np.add.at(self.later[stage], item[beyond], most[beyond])
        whole = np.zeros(self.items, np.float64)
        np.add.at(whole, item, most.astype(np.float64))
        # Doubles where they are exact, as their products are fast; else whole numbers.
        self.kind = np.float64 if whole.max(initial=0) < _EXACT else np.int64

    def width(self, bundle: int) -> int:
        return min(self.bundle, self.items - bundle * self.bundle)


def _owned(plan, stage: int):
    """The owner's postings by bundle and block."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: _Plan = plan.value
        for batch in batches:
            for row in batch.to_pylist():
                terms, runs = np.frombuffer(row["terms"], np.int32), np.frombuffer(row["runs"], np.int32)
                slots, times = np.frombuffer(row["slots"], np.uint16), np.frombuffer(row["times"], np.int32)
                for bundle, (used, _, _) in p.uses.items():
                    chosen = (p.owner[terms] == stage) & np.isin(terms, used) & (p.weight[terms] > 0)
                    each = np.repeat(chosen, runs)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([bundle], pa.int32()), pa.array([row["block"]]),
                            pa.array([row["docs"]], pa.list_(pa.int64())), pa.array([row["lengths"]], pa.binary()),
                            pa.array([terms[chosen].tobytes()], pa.binary()), pa.array([runs[chosen].tobytes()], pa.binary()),
                            pa.array([slots[each].tobytes()], pa.binary()), pa.array([times[each].tobytes()], pa.binary()),
                        ],
                        names=["bundle", "block", "docs", "lengths", "terms", "runs", "slots", "times"],
                    )

    return cut


_OWNED = "bundle int, block bigint, docs array<bigint>, lengths binary, terms binary, runs binary, slots binary, times binary"


def _stage(plan, stage: int, floors):
    """Add an owner's contributions to the accumulators of one bundle and block."""

    def add(state: pa.Table, postings: pa.Table) -> pa.Table:
        p: _Plan = plan.value
        row = postings.to_pylist()[0]
        bundle, docs = row["bundle"], row["docs"]
        width, n = p.width(bundle), len(docs)
        lengths = np.frombuffer(row["lengths"], np.int64)
        scores = np.zeros((width, n), p.kind)
        for held in state.to_pylist():
            at = np.frombuffer(held["items"], np.int16), np.frombuffer(held["slots"], np.uint16)
            scores[at] = np.frombuffer(held["scores"], np.int64)
        terms, runs = np.frombuffer(row["terms"], np.int32), np.frombuffer(row["runs"], np.int32)
        if len(terms):
            slots, times = np.frombuffer(row["slots"], np.uint16), np.frombuffer(row["times"], np.int32).astype(np.int64)
            m = 100 - 75 + (75 * lengths * p.n_docs) // p.n_terms
            parts = (1_000_000_000 * times) // (1000 * times + 8 * m[slots]) * p.weight[np.repeat(terms, runs)]
            used, items, repeats = p.uses[bundle]
            ends = np.cumsum(runs)
            for start in range(0, len(terms), 256):
                some = terms[start : start + 256]
                low, high = ends[start] - runs[start], ends[start + len(some) - 1]
                matrix = np.zeros((len(some), n), p.kind)
                matrix[np.repeat(np.arange(len(some)), runs[start : start + len(some)]), slots[low:high]] = parts[low:high]
                weights = np.zeros((width, len(some)), p.kind)
                place = np.minimum(np.searchsorted(some, used), len(some) - 1)
                here = some[place] == used
                weights[items[here], place[here]] = repeats[here]
                scores += weights @ matrix
        own = slice(bundle * p.bundle, bundle * p.bundle + width)
        alive = (scores > 0) & (scores + p.later[stage][own, None] >= floors[own, None])
        k = min(p.k, n)
        best = -np.partition(-scores, k - 1, axis=1)[:, :k]
        if stage == p.stages - 1 and k < n:
            # The last stage keeps what is in the block's best, ties included.
            alive &= scores >= best.min(axis=1)[:, None]
        items, slots = np.nonzero(alive)
        values = [
            [bundle], [row["block"]], [items.astype(np.int16).tobytes()], [slots.astype(np.uint16).tobytes()],
            [scores[items, slots].astype(np.int64).tobytes()], [best.astype(np.int64).tobytes()], [docs],
        ]
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4, pa.list_(pa.int64())]
        return pa.table([pa.array(v, t) for v, t in zip(values, kinds)], names=[c.split()[0] for c in _STATE.split(", ")])

    return add


def _best_so_far(plan):
    """Per task, the ``k`` largest scores of each item."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: _Plan = plan.value
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for bundle, best in zip(batch.column("bundle").to_pylist(), batch.column("best").to_pylist()):
                scores = np.frombuffer(best, np.int64).reshape(p.width(bundle), -1)
                if bundle in held:
                    scores = np.concatenate([held[bundle], scores], axis=1)
                held[bundle] = -np.sort(-scores, axis=1)[:, : p.k]
        for bundle, scores in held.items():
            item = bundle * p.bundle + np.repeat(np.arange(len(scores)), scores.shape[1])
            keep = scores.ravel() > 0
            yield pa.RecordBatch.from_arrays([pa.array(item[keep]), pa.array(scores.ravel()[keep])], names=["item", "score"])

    return merge


def _unpacked(bundle: int):
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                items, slots = np.frombuffer(row["items"], np.int16), np.frombuffer(row["slots"], np.uint16)
                docs = pa.array(row["docs"], pa.int64()).take(pa.array(slots))
                item = pa.array(row["bundle"] * bundle + items.astype(np.int64))
                scores = pa.array(np.frombuffer(row["scores"], np.int64))
                yield pa.RecordBatch.from_arrays([item, docs, scores], names=["item", "doc", "score"])

    return unpack


def _item_terms(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """Distinct terms of each item row with their repeats, and the run that takes the item."""
    rows = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "items")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = F.regexp_extract_all(F.translate("text", upper, lower), F.lit(f"({TERM})"), F.lit(1))
    pairs = rows.select("row", "item_id", F.explode(terms).alias("term")).groupBy("row", "item_id", "term").count()
    pairs = written(pairs, "item-terms")
    sizes = pairs.groupBy("row").count().withColumn("stream", F.lit(0))
    runs = running_sum(sizes, ["stream"], ["row"], "count", "upto")
    runs = runs.select("row", F.expr(f"(upto - 1) div {RUN_PAIRS}").alias("run"))
    return written(pairs.join(runs, "row"), "item-runs")


def ranked_search(
    df: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, k: int = 10, owners: int = OWNERS
) -> DataFrame:
    """The ``k`` best documents for each item: ``item_id``, ``rank`` (from 1), ``doc_id``, ``score``.

    Terms are runs of ASCII letters and digits and all characters beyond ASCII, A-Z lowered. Scores are
    whole numbers; only those above 0 are ranked, equal ones by document id, null last.

    A null or empty text has no term and is in no ranking and no statistic; an item without terms has no
    rows. Rows with null or repeated document ids are documents of their own, rows of repeated item
    ids items of their own; other columns are not used. An empty table on either side gives no rows.
    """
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    wanted = _item_terms(items, item_id, item_text)
    results = None
    # One run holds RUN_PAIRS pairs, or one item: usually all items are one run.
    for (run,) in wanted.select("run").distinct().orderBy("run").collect():
        ranked = _searched(docs, wanted.filter(F.col("run") == run), k, owners)
        results = ranked if results is None else results.unionByName(ranked)
    if results is None:
        results = spark.createDataFrame([], f"item_id {items.schema[item_id].dataType.simpleString()}, rank int, doc_id bigint, score bigint")
    return results.withColumnsRenamed({"item_id": item_id, "doc_id": doc_id})


def _searched(docs: DataFrame, wanted: DataFrame, k: int, owners: int) -> DataFrame:
    spark = docs.sparkSession
    context = spark.sparkContext
    table = wanted.select("row", "term", "count").toArrow()
    rows, item = np.unique(table.column("row").to_numpy(), return_inverse=True)
    coded = table.column("term").combine_chunks()
    coded = (coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded).dictionary_encode()
    term = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    vocabulary = context.broadcast(coded.dictionary.cast(pa.large_string()))
    index = written(docs.mapInArrow(_indexed(vocabulary, BLOCK_DOCS), _INDEX), "postings")

    totals = index.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    found = index.select("terms", "runs").mapInArrow(_frequencies(len(coded.dictionary)), "term bigint, df bigint")
    df = np.zeros(len(coded.dictionary), np.int64)
    # At most a row per term of this run.
    for row in found.groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[row["term"]] = row["df"]
    shared = _Plan(item, term, table.column("count").to_numpy(), df, totals["docs"] or 0, max(1, totals["terms"] or 0), owners, k)
    plan = context.broadcast(shared)

    floors = np.zeros(shared.items, np.int64)
    state = spark.createDataFrame([], _STATE)
    for stage in range(owners):
        postings = index.mapInArrow(_owned(plan, stage), _OWNED)
        sides = state.groupBy("bundle", "block").cogroup(postings.groupBy("bundle", "block"))
        state = written(sides.applyInArrow(_stage(plan, stage, floors), _STATE), "accumulators")
        if stage < owners - 1:
            best = state.select("bundle", "best").mapInArrow(_best_so_far(plan), "item bigint, score bigint")
            place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score")))
            # One number an item: its k-th best score so far.
            for row in best.withColumn("place", place).filter(F.col("place") == k).collect():
                floors[row["item"]] = max(floors[row["item"]], row["score"])
            floors = floors.copy()
    named = wanted.select("row", "item_id").distinct()
    dense = spark.createDataFrame(pa.table({"item": np.arange(len(rows)), "row": rows}))
    candidates = state.select("bundle", "items", "slots", "scores", "docs").mapInArrow(_unpacked(shared.bundle), "item bigint, doc bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    ranked = candidates.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k)
    joined = ranked.join(dense.join(named, "row"), "item")
    return joined.select("item_id", "rank", F.col("doc").alias("doc_id"), "score")

"""Exact largest inner products of integer vectors, by length and rotated partial sums.

Candidates are taken by descending length. No candidate from there on can beat the k-th
best once the product of the lengths falls below it. Vectors are rotated onto the
principal axes of all vectors, so that a few leading coordinates hold most of a product; the
rest is bounded by the product of the lengths that remain (Cauchy-Schwarz). Pairs
that pass are computed in whole integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.vectors import Best, grid_search, matrix, offer_pairs, usable_vectors

TILE_QUERIES, TILE_CANDIDATES = 512, 2048
EXACT_PAIRS = 1 << 15
# Sums of all partitions are added up in so many groups before the driver adds the last ones.
GROUPS = 16
# Largest sum of products that doubles hold exactly; products are kept within what longs hold.
EXACT_SUM, LONG = float(1 << 53), (1 << 63) - 1


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per dimension, the sum of outer products of a task's vectors, each scaled to length 1."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = np.asarray(batch.column("dim"))
        for dim in np.unique(dims):
            x = matrix(pa.table({"v": batch.filter(pa.array(dims == dim)).column("v")}))
            length = np.sqrt((x * x).sum(axis=1, keepdims=True))
            x = x / np.where(length > 0, length, 1)
            sums[int(dim)] = sums.get(int(dim), 0) + np.nan_to_num(x.T @ x)
    slot = TaskContext.get().partitionId() % GROUPS
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([slot] * len(sums), pa.int32()),
            pa.array(list(sums), pa.int32()),
            pa.array([s.tobytes() for s in sums.values()], pa.binary()),
        ],
        names=["slot", "dim", "gram"],
    )


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(g, np.float64) for g in table.column("gram").to_pylist())
    return pa.table({"dim": table.column("dim")[:1], "gram": pa.array([total.tobytes()], pa.binary())})


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Per dimension, the axes of all vectors' directions as columns, most important first."""
    partial = vectors.select("v", "dim").mapInArrow(_grams, "slot int, dim int, gram binary")
    rows = partial.groupBy("slot", "dim").applyInArrow(_added, "dim int, gram binary").collect()
    sums: dict[int, np.ndarray] = {}
    for row in rows:
        gram = np.frombuffer(row["gram"], np.float64).reshape(row["dim"], row["dim"])
        sums[row["dim"]] = sums.get(row["dim"], 0) + gram
    return {dim: np.linalg.eigh(gram)[1][:, ::-1].copy() for dim, gram in sums.items()}


def _residuals(rotated: np.ndarray, heads: list[int]) -> list[np.ndarray]:
    squares = rotated * rotated
    return [np.sqrt(squares[:, h:].sum(axis=1)) for h in heads]


def _search(k: int, axes: dict[int, np.ndarray]):
    def search(query_ids, queries, candidate_ids, candidates) -> Best:
        dim = queries.shape[1]
        best = Best(len(queries), k)
        # Vectors whose products could leave doubles are multiplied as Python integers.
        safe = np.sqrt(EXACT_SUM / dim)
        small_q, small_c = np.abs(queries).max(axis=1) <= safe, np.abs(candidates).max(axis=1) <= safe
        everyone = np.ones(len(candidates), bool)
        for row in range(len(queries)):
            _offer_large(best, row, query_ids, queries, candidate_ids, candidates, ~small_c if small_q[row] else everyone)
        qs = np.flatnonzero(small_q)
        cs = np.flatnonzero(small_c)
        lengths = np.sqrt((candidates[cs] ** 2).sum(axis=1))
        cs = cs[np.argsort(-lengths, kind="stable")]
        if not len(qs) or not len(cs):
            return best
        heads = sorted({max(1, dim // 4), max(1, dim // 2)})
        turned_q, turned_c = queries[qs] @ axes[dim], candidates[cs] @ axes[dim]
        rest_q, rest_c = _residuals(turned_q, heads), _residuals(turned_c, heads)
        length_q, length_c = (np.sqrt((x * x).sum(axis=1)) for x in (turned_q, turned_c))
        for low in range(0, len(cs), TILE_CANDIDATES):
            own = slice(low, low + TILE_CANDIDATES)
            # Rounding of the rotation, far above what doubles lose.
            slack = 1 + 1e-9 * length_q * length_c[low]
            open_ = np.flatnonzero(length_q * length_c[low] + slack >= best.bar[qs])
            if not len(open_):
                break
            for at in range(0, len(open_), TILE_QUERIES):
                rows = open_[at : at + TILE_QUERIES]
                _tile(best, qs[rows], rows, cs[own], own, heads, turned_q, turned_c, rest_q, rest_c, slack, query_ids, queries, candidate_ids, candidates)
        return best

    return search


def _tile(best, at_q, rows, at_c, own, heads, turned_q, turned_c, rest_q, rest_c, slack, query_ids, queries, candidate_ids, candidates) -> None:
    bar = (best.bar[at_q] - slack[rows])[:, None]
    partial, done = np.zeros((len(rows), len(at_c))), 0
    alive = query_ids[at_q][:, None] != candidate_ids[at_c][None, :]
    for head, left_q, left_c in zip(heads, rest_q, rest_c):
        partial += turned_q[rows, done:head] @ turned_c[own, done:head].T
        done = head
        alive &= partial + np.outer(left_q[rows], left_c[own]) >= bar
        if np.count_nonzero(alive) * 16 < alive.size:
            break
    places, partners = np.nonzero(alive)
    if len(places) * 16 >= alive.size:
        # Too many to pick: whole integer products of the tile, which doubles hold exactly.
        scores = (queries[at_q] @ candidates[at_c].T)[places, partners]
        offer_pairs(best, at_q[places], scores.astype(np.int64), candidate_ids[at_c[partners]])
        return
    for start in range(0, len(places), EXACT_PAIRS):
        i, j = at_q[places[start : start + EXACT_PAIRS]], at_c[partners[start : start + EXACT_PAIRS]]
        scores = (queries[i] * candidates[j]).sum(axis=1).astype(np.int64)
        offer_pairs(best, i, scores, candidate_ids[j])


def _offer_large(best, row, query_ids, queries, candidate_ids, candidates, chosen) -> None:
    q = None
    for j in np.flatnonzero(chosen & (candidate_ids != query_ids[row])):
        q = q or [int(x) for x in queries[row]]
        score = sum(a * int(b) for a, b in zip(q, candidates[j]))
        best.offer(row, [max(-LONG - 1, min(LONG, score))], [int(candidate_ids[j])])


def largest_products(df: DataFrame, vec_id: str, embedding: str, is_query: Column, k: int, scale: int = 256) -> DataFrame:
    """The ``k`` largest products for each query over vectors with components ``floor(scale * x)``.

    Queries are the rows where ``is_query`` holds, candidates all rows but those with the query's id. One row
    per query and candidate: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (long, exact; a product that longs
    cannot hold becomes the nearest long), ties to smaller ids. Null ids and vectors, empty vectors
    and those with null or non-finite components (before or after scaling) take no part, nor do vectors of another
    dimension than the query's; zero vectors do. Repeated rows are candidates of their own; a query with
    fewer candidates gets all of them. An empty table gives an empty result. Other columns are
    not used.
    """
    scaled = F.transform(F.col(embedding).cast("array<double>"), lambda x: F.lit(float(scale)) * x)
    whole = df.select(F.col(vec_id).alias("id"), scaled.alias("v"), is_query.alias("asks"))

    def floored(rows: DataFrame) -> DataFrame:
        # Spark's floor of a double is a long and would cut large values; x - x mod 1 does not.
        usable = usable_vectors(rows, "id", "v", zero=True)
        return usable.withColumn("v", F.transform("v", lambda x: x - F.pmod(x, F.lit(1.0))))

    candidates = floored(whole)
    axes = principal_axes(candidates)
    return grid_search(floored(whole.filter("asks")), candidates, _search(k, axes), k, "bigint")

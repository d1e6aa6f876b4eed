"""Top-k searches of a query set against all rows as a grid of blocks.

Queries and candidates are dealt to a grid: a query goes to one row of cells, a candidate
to one column, each by a hash of its id. A cell holds a bounded number of both, finds the best of
its own candidates for each of its queries, and the lists of a query's cells are merged.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.session import parallelism

# Bounds of a cell, in values, so that longer vectors make smaller cells.
CELL_QUERY_VALUES, CELL_CANDIDATE_VALUES = 1 << 20, 1 << 22
_FOUND_DDL = "query_id bigint, vector array<double>, vec_ids array<bigint>, scores {score}"


def usable_vectors(df: DataFrame, vec_id: str, embedding: str, zero: bool) -> DataFrame:
    """(``id``, ``v``, ``dim``) of the vectors that take part.

    Null ids, null vectors, empty ones, and those with null or non-finite components are left out; without
    ``zero`` also vectors of length zero.
    """
    v = F.col(embedding).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = df.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad
    )
    if not zero:
        kept = kept.filter(F.exists("v", lambda x: x != 0))
    return kept.withColumn("dim", F.size("v"))


def matrix(table: pa.Table, column: str = "v") -> np.ndarray:
    """A column of equally long lists as a matrix."""
    values = table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return values.reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 1))


class Best:
    """The ``k`` best candidates of each query so far: a heap per query, worst on top."""

    def __init__(self, queries: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(queries)]
        #: Score that a candidate has to reach; -inf until a heap is full.
        self.bar = np.full(queries, -np.inf)

    def offer(self, query: int, scores: list, ids: list) -> None:
        heap = self.heaps[query]
        for score, vec in zip(scores, ids):
            # Of equal scores the smaller id is better.
            if len(heap) < self.k:
                heapq.heappush(heap, (score, -vec))
            elif (score, -vec) > heap[0]:
                heapq.heapreplace(heap, (score, -vec))
        if len(heap) == self.k:
            self.bar[query] = heap[0][0]

    def lists(self) -> Iterator[tuple[int, list[int], list]]:
        for query, heap in enumerate(self.heaps):
            if heap:
                ordered = sorted(heap, reverse=True)
                yield query, [-v for _, v in ordered], [s for s, _ in ordered]


def offer_pairs(best: Best, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
    """Offer scored pairs; ``rows`` are query places in ascending order."""
    keep = scores >= best.bar[rows]
    rows, scores, ids = rows[keep], scores[keep], ids[keep]
    cuts = np.flatnonzero(np.diff(rows)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(rows)]):
        if a < b:
            best.offer(int(rows[a]), scores[a:b].tolist(), ids[a:b].tolist())


def grid_search(
    queries: DataFrame,
    candidates: DataFrame,
    search: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Best],
    k: int,
    score_type: str,
) -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``) of the ``k`` best of each query.

    ``search(query_ids, query_vectors, candidate_ids, candidate_vectors)`` works on one cell and leaves
    out candidates with the query's own id. Vectors of another dimension are no candidates.
    """
    spark = queries.sparkSession
    sizes = candidates.agg(F.count("*").alias("n"), F.max("dim").alias("d"), F.sum("dim").alias("values")).first()
    asked = queries.agg(F.sum("dim").alias("values")).first()
    across = max(1, -(-(asked["values"] or 0) // CELL_QUERY_VALUES))
    down = max(parallelism(spark), -(-(sizes["values"] or 0) // CELL_CANDIDATE_VALUES))
    row, column = F.pmod(F.xxhash64("id"), F.lit(across)), F.pmod(F.xxhash64("id"), F.lit(down))
    q = queries.distinct().withColumn("h", row).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))))
    c = candidates.withColumn("g", column).withColumn("h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))))
    ddl = _FOUND_DDL.format(score=f"array<{score_type}>")
    kind = pa.int64() if score_type == "bigint" else pa.float64()

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, vectors = left.column("id").to_numpy(), matrix(left)
            best = search(ids, vectors, right.column("id").to_numpy(), matrix(right))
            found = [(ids[i], vectors[i], vecs, scores) for i, vecs, scores in best.lists()]
        columns = list(zip(*found)) if found else [()] * 4
        kinds = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(kind)]
        names = ["query_id", "vector", "vec_ids", "scores"]
        return pa.table({n: pa.array(list(col), t) for n, col, t in zip(names, columns, kinds)})

    keys = ["h", "g", "dim"]
    lists = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(cell, ddl)
    # A repeated query id with another vector is a query of its own.
    together = lists.withColumn("vector", F.xxhash64("vector")).repartition("query_id", "vector")
    merged = together.sortWithinPartitions("query_id", "vector").mapInArrow(
        _merged(k, kind), f"query_id bigint, rank int, vec_id bigint, score {score_type}"
    )
    return merged


def _merged(k: int, kind: pa.DataType):
    """Merge the sorted lists of each query, which come one after the other, by a heap."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lists = None, []

        def best() -> list[tuple]:
            taken = heapq.merge(*lists, key=lambda e: (-e[0], e[1]))
            return [(key[0], rank, vec, score) for rank, (score, vec) in zip(range(1, k + 1), taken)]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * 4
            kinds = [pa.int64(), pa.int32(), pa.int64(), kind]
            names = ["query_id", "rank", "vec_id", "score"]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=names)

        for batch in batches:
            rows: list[tuple] = []
            for query, vector, vecs, scores in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (query, vector) != key:
                    if key is not None:
                        rows += best()
                    key, lists = (query, vector), []
                lists.append(list(zip(scores, vecs)))
            yield table(rows)
        if key is not None:
            yield table(best())

    return merge

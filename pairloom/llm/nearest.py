"""Nearest neighbours by a block matrix join of int8 vectors.

Vectors are scaled to 8-bit integers. A tile of integer products gives every inner product
within a bound that follows from the lengths of the quantisation errors. Only pairs whose upper
bound reaches the query's k-th best so far are computed again from the original vectors,
in double precision; a heap per query keeps the best.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.vectors import Best, grid_search, offer_pairs, usable_vectors

TILE_QUERIES, TILE_CANDIDATES = 512, 4096
# Pairs computed again at once.
EXACT_PAIRS = 1 << 15
# Above this length, products of int8 vectors can leave what single precision holds exactly.
SINGLE_LENGTH = (1 << 24) // (127 * 127)


class _Quantised:
    """int8 codes with their scales, and the lengths that bound the error."""

    def __init__(self, vectors: np.ndarray):
        self.scale = np.abs(vectors).max(axis=1) / 127
        self.scale[self.scale == 0] = np.finfo(np.float64).tiny
        codes = np.rint(vectors / self.scale[:, None])
        self.codes = codes.astype(np.float32 if vectors.shape[1] <= SINGLE_LENGTH else np.float64)
        rounded = codes * self.scale[:, None]
        self.rounded_length = _length(rounded)
        self.error_length = _length(vectors - rounded)
        self.length = _length(vectors)


def _length(vectors: np.ndarray) -> np.ndarray:
    most = np.abs(vectors).max(axis=1, keepdims=True)
    safe = np.where(most > 0, most, 1)
    return most[:, 0] * np.sqrt(((vectors / safe) ** 2).sum(axis=1))


def _search(k: int):
    def search(query_ids, queries, candidate_ids, candidates) -> Best:
        best = Best(len(queries), k)
        q, c = _Quantised(queries), _Quantised(candidates)
        for low in range(0, len(candidates), TILE_CANDIDATES):
            own = slice(low, low + TILE_CANDIDATES)
            for at in range(0, len(queries), TILE_QUERIES):
                rows = slice(at, at + TILE_QUERIES)
                near = (q.codes[rows] @ c.codes[own].T).astype(np.float64)
                near *= q.scale[rows, None] * c.scale[None, own]
                error = np.outer(q.rounded_length[rows], c.error_length[own]) + np.outer(q.error_length[rows], c.length[own])
                # Rounding of these double computations themselves.
                error += 1e-12 * np.outer(q.length[rows], c.length[own])
                itself = query_ids[rows, None] == candidate_ids[None, own]
                bar = best.bar[rows]
                if near.shape[1] > k:
                    lower = np.where(itself, -np.inf, near - error)
                    bar = np.maximum(bar, -np.partition(-lower, k - 1, axis=1)[:, k - 1])
                places, partners = np.nonzero((near + error >= bar[:, None]) & ~itself)
                for start in range(0, len(places), EXACT_PAIRS):
                    i, j = places[start : start + EXACT_PAIRS] + at, partners[start : start + EXACT_PAIRS] + low
                    # A row sum, not a matrix product: equal vectors get equal scores wherever they stand.
                    scores = (queries[i] * candidates[j]).sum(axis=1)
                    offer_pairs(best, i, scores, candidate_ids[j])
        return best

    return search


def nearest(df: DataFrame, vec_id: str, embedding: str, is_query: Column, k: int) -> DataFrame:
    """The ``k`` candidates of largest inner product for each query, nearest first, ties to smaller ids.

    Queries are the rows where ``is_query`` holds, candidates all rows but those with the query's id. One row
    per query and neighbour: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (double precision, on
    the original vectors). The bounds never lose a neighbour, so the result is exact. Null ids and
    vectors, zero vectors and those with null or non-finite components take no part, nor do
    vectors of another dimension than the query's; repeated rows are candidates of their own; a query with fewer
    candidates gets all of them, and one without any no row. An empty table gives an empty
    result. Other columns are not used.
    """
    marked = df.filter(is_query)
    queries = usable_vectors(marked, vec_id, embedding, zero=False)
    return grid_search(queries, usable_vectors(df, vec_id, embedding, zero=False), _search(k), k, "double")

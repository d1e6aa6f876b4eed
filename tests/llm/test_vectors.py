import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from check import rows_of
from pairloom.llm import maxproduct, nearest, vectors
from pairloom.llm.maxproduct import largest_products
from pairloom.llm.queries import ORACLES, QUERIES

DDL = "vec_id bigint, embedding array<float>, id string, v int"


def rows_with_corners(n=150, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in (rng.standard_normal(dim) * rng.choice([0.1, 1, 5])).astype(np.float32)], "a", 1) for i in range(n)]
    # A hot vector with many copies, and rows that take no part.
    rows += [(1000 + i, rows[3][1], "b", 2) for i in range(60)] + [(2000, rows[5][1], "c", 3), (2000, rows[5][1], "c", 3)]
    nan, inf = float("nan"), float("inf")
    rows += [(3000, None, "n", 0), (3001, [nan] * dim, "n", 0), (3002, [inf] * dim, "n", 0), (3003, [None] * dim, "n", 0)]
    rows += [(None, rows[0][1], "n", 0), (3004, [], "n", 0), (3010, [1.0] * (dim - 1), "short", 0)]
    return rows


def usable(rows, zero):
    out = []
    for vec, emb, *_ in rows:
        if vec is None or not emb or any(x is None or not math.isfinite(x) for x in emb):
            continue
        v = np.array(emb, np.float64)
        if zero or v.any():
            out.append((vec, v))
    return out


def brute(rows, every, k, score, zero):
    found = []
    use = usable(rows, zero)
    for q, v in {(q, tuple(v)): (q, v) for q, v in use if q % every == 0}.values():
        scored = sorted((-score(v, w), c) for c, w in use if c != q and len(w) == len(v))
        found += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scored[:k])]
    return found


@pytest.mark.parametrize("cells", [1 << 22, 100])
def test_nearest_against_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(vectors, "CELL_QUERY_VALUES", cells)
    monkeypatch.setattr(vectors, "CELL_CANDIDATE_VALUES", cells)
    monkeypatch.setattr(nearest, "TILE_CANDIDATES", 16)
    rows = rows_with_corners() + [(4000, [0.0] * 8, "zero", 0)]
    df = spark.createDataFrame(rows, DDL)
    got = nearest.nearest(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 7).collect()
    want = brute(rows, 20, 7, lambda a, b: float((a * b).sum()), zero=False)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)


@pytest.mark.parametrize("cells", [1 << 22, 100])
def test_largest_products_against_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(vectors, "CELL_QUERY_VALUES", cells)
    monkeypatch.setattr(vectors, "CELL_CANDIDATE_VALUES", cells)
    monkeypatch.setattr(maxproduct, "TILE_CANDIDATES", 16)
    rows = rows_with_corners(seed=2) + [(4000, [0.0] * 8, "zero", 0), (4001, [3e38, -3e38] + [1e20] * 6, "huge", 0), (4050, [1e15] * 8, "large", 0)]
    df = spark.createDataFrame(rows, DDL)
    got = largest_products(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5).collect()

    def product(a, b):
        whole = sum(int(math.floor(256 * x)) * int(math.floor(256 * y)) for x, y in zip(a, b))
        return max(-(1 << 63), min((1 << 63) - 1, whole))

    want = brute(rows, 50, 5, product, zero=True)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)


def test_few_candidates_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], "", 0), (1, [1.0, 0.5], "", 0), (20, [0.5, 0.5, 0.5], "", 0)], DDL)
    rows = nearest.nearest(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 5).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in rows] == [(0, 1, 1)]
    none = df.limit(0)
    assert nearest.nearest(none, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 5).count() == 0
    assert largest_products(none, "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5).count() == 0


def test_quantised_bounds_hold():
    rng = np.random.default_rng(4)
    a, b = rng.standard_normal((40, 32)) * 3, rng.standard_normal((50, 32))
    q, c = nearest._Quantised(a), nearest._Quantised(b)
    near = (q.codes @ c.codes.T).astype(np.float64) * q.scale[:, None] * c.scale
    error = np.outer(q.rounded_length, c.error_length) + np.outer(q.error_length, c.length)
    assert (np.abs(a @ b.T - near) <= error + 1e-9).all()


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    df = QUERIES["op9_largest_products"](spark, folder)
    cursor = db.execute(ORACLES["op9_largest_products"])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cursor.description], cursor.fetchall())


def test_nearest_query_finds_all(spark):
    df = QUERIES["op3_block_nearest"](spark, "/root/testdata/sf0.001")
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    want = brute(rows, 20, 20, lambda a, b: float((a * b).sum()), zero=False)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()) == sorted(want)

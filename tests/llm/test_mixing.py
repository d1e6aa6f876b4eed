import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from check import rows_of
from pairloom.llm.columns import word_count
from pairloom.llm.mixing import mix_to_targets
from pairloom.llm.queries import ORACLES, QUERIES


def brute(rows, weights=(5, 2, 1), most=3, seed=0):
    """Targets by sharing what is above again and again; thresholds by sorting."""
    sizes = {}
    for _, source, size in rows:
        sizes[source] = sizes.get(source, 0) + (size or 0)
    ranked = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(ranked)}
    total, stopped = sum(sizes.values()), set()
    while True:
        open_ = [s for s in ranked if s not in stopped]
        level = (total - sum(most * sizes[s] for s in stopped)) / sum(weight[s] for s in open_) if open_ else 0
        above = [s for s in open_ if level * weight[s] > most * sizes[s]]
        if not above:
            break
        stopped |= set(above)
    target = {s: float(most * sizes[s]) if s in stopped else level * weight[s] for s in ranked}
    out = []
    for source in ranked:
        own = {}
        for key, s, size in rows:
            if s == source:
                digest = hashlib.md5(f"{seed}|{'' if key is None else key}".encode()).hexdigest()
                own.setdefault(int(digest[:15], 16), []).append((key, size or 0))
        full = min(most, int(target[source] // sizes[source])) if sizes[source] else 0
        left = target[source] - full * sizes[source]
        for h in sorted(own):
            words = sum(s for _, s in own[h])
            more = left > 0 and full < most and (words <= left or (left > 0 and 2 * left >= words))
            if left > 0 and words > left:
                # The document at the border: nothing is taken after it.
                out += [(k, source, s, full + (2 * left >= words)) for k, s in own[h]]
                left = -1
                continue
            out += [(k, source, s, full + more) for k, s in own[h]]
            left -= words
            if left == 0:
                left = 0
    return sorted(((k, s, z, c) for k, s, z, c in out), key=str), target


def test_against_brute_force(spark):
    rows = [(i, None if i % 7 == 0 else f"s{i % 7}", (i * 37) % 101) for i in range(400)]
    rows += [(1000 + i, "tiny", 1) for i in range(3)] + [(None, "s1", 10), (None, "s1", 10), (5, "s5", None)]
    df = spark.createDataFrame(rows, "k bigint, src string, size bigint").withColumn("_hash", F.lit("mine"))
    mixed = mix_to_targets(df, "src", "size", "k")
    got = mixed.collect()
    want, targets = brute(rows)
    assert sorted(((r["k"], r["src"], r["size"] or 0, r["copies"]) for r in got), key=str) == want
    assert all(r["target"] == pytest.approx(targets[r["src"]]) for r in got)
    assert all(r["taken"] == (r["size"] or 0) * r["copies"] <= 3 * (r["size"] or 0) for r in got)
    assert {r["_hash"] for r in got} == {"mine"}
    assert sum(targets.values()) == pytest.approx(sum(r[2] or 0 for r in rows))
    taken = {}
    for r in got:
        taken[r["src"]] = taken.get(r["src"], 0) + r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 60 for s in taken)


def test_edge_cases(spark, docs, empty):
    sized = docs.withColumn("size", word_count(F.col("text")))
    mixed = mix_to_targets(sized, "source", "size", "doc_id")
    assert mixed.count() == docs.count()
    assert mixed.columns == [*sized.columns, "source_size", "target", "copies", "taken"]
    assert mix_to_targets(empty.withColumn("size", F.lit(1)), "source", "size", "doc_id").count() == 0
    nothing = spark.createDataFrame([(1, "a", 0), (2, None, None)], "doc_id bigint, source string, size bigint")
    assert {(r["target"], r["copies"], r["taken"]) for r in mix_to_targets(nothing, "source", "size", "doc_id").collect()} == {(0.0, 0, 0)}


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    df = QUERIES["op7_mix_sources"](spark, folder)
    cursor = db.execute(ORACLES["op7_mix_sources"])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cursor.description], cursor.fetchall())

from collections import defaultdict

from pyspark.sql import functions as F

from pairloom.llm.sharding import feistel_shards, with_permuted


def test_permutation_is_one_to_one_at_every_size(spark):
    for rows in (1, 2, 3, 5, 10, 101, 1000):
        df = with_permuted(spark.range(rows), "id", rows, 3, "at")
        assert sorted(r["at"] for r in df.collect()) == list(range(rows))


def test_walking_points_match_the_staged_network(spark):
    # 101 rows leave 9 of 110 points to walk over; every place is hit once all the same.
    places = {r["id"]: r["at"] for r in with_permuted(spark.range(101), "id", 101, 9, "at").collect()}
    again = {r["id"]: r["at"] for r in with_permuted(spark.range(101).repartition(7), "id", 101, 9, "at").collect()}
    other = {r["id"]: r["at"] for r in with_permuted(spark.range(101), "id", 101, 10, "at").collect()}
    assert places == again != other
    assert sum(places[i] == i for i in places) < 15


def test_all_rows_are_placed_with_even_shards(spark, docs):
    df = docs.withColumns({"shard": F.lit("mine"), "_row": F.lit(1), "_number": F.lit(2)})
    placed = feistel_shards(df, ["doc_id", "text"], shards=4, seed=1)
    assert placed.columns == [c for c in df.columns if c != "shard"] + ["shard", "slot"]
    rows = placed.collect()
    slots = defaultdict(list)
    for row in rows:
        slots[row["shard"]].append(row["slot"])
    assert sum(map(len, slots.values())) == df.count()
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    key = lambda r: (r["doc_id"] or -1, r["text"] or "", r["shard"], r["slot"])
    again = feistel_shards(df.repartition(5), ["doc_id", "text"], shards=4, seed=1).collect()
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_empty_table(empty):
    assert feistel_shards(empty, ["doc_id"], shards=4).count() == 0

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_jaccard import brute
from test_toxicity import texts_and_labels

import __spark_entry__ as entry
import corpus_pipeline
from pairloom.llm.mixing import mix_to_targets
from pairloom.session import scratch_path


@pytest.fixture(scope="module")
def folder(spark):
    rows, labels = texts_and_labels(200)
    clean = [(i, t) for i, t in rows]
    copies = [(1000 + i, t) for i, t in rows[1:40:4]] + [(2000 + i, t + " tail") for i, t in rows[1:40:4]]
    data = [(d, t, "en", f"s{d % 3}", len(t)) for d, t in clean + copies]
    data += [(3000, None, "en", None, None), (3001, "", "en", "s1", 0), (None, "no id here at all", None, "s2", 5)]
    path = scratch_path(spark, "test-pipeline")
    spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_every_operator_has_one_query():
    names = Counter(n.split("_")[0] for n in entry.queries() if n.startswith("op"))
    assert names == {f"op{i}": 1 for i in range(1, 14)}
    assert "pipeline" in entry.queries()


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    calm = stages["toxicity"](spark, docs, folder).cache()
    assert calm.columns == docs.columns
    kept = {r["doc_id"] for r in calm.collect()}
    toxic, clean = set(range(0, 200, 4)), {i for i in range(200) if i % 4}
    assert len(kept & toxic) <= 0.15 * len(toxic) and len(kept & clean) >= 0.9 * len(clean)
    assert {3000, 3001, None} <= kept

    alone = stages["near_duplicates"](spark, calm, folder).cache()
    assert alone.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in calm.collect()]
    want = {d for d, _, c in brute(rows, 5, 80) if d is None or d == c}
    assert Counter(r["doc_id"] for r in alone.collect()) == Counter(want)

    mixed = stages["mixing"](spark, alone, folder).cache()
    assert mixed.columns == docs.columns
    sized = alone.withColumn("size", corpus_pipeline.word_count(F.col("text")))
    copies = {r["doc_id"]: r["copies"] for r in mix_to_targets(sized, "source", "size", "doc_id", seed=7).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({d: c for d, c in copies.items() if c})

    packed = stages["packing"](spark, mixed, folder).collect()
    assert sum(r["length"] for r in packed if r["start"] == 0) > 0
    sequences = defaultdict(int)
    for r in packed:
        sequences[r["sequence_id"]] += r["length"]
    assert all(n == 2048 for s, n in sequences.items() if s != max(sequences))


def test_run_gives_the_stages_in_turn(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {"doc_id", "sequence_id", "offset", "length", "ids"} <= set(rows[0].asDict())
    assert max(r["sequence_id"] for r in rows) + 1 == len({r["sequence_id"] for r in rows})


def test_rows_are_told_apart_by_their_texts(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "other words of another text"), (None, "x y"), (None, "x y")]
    rows += [(7, "x y z"), (None, "x y z"), (9, None), (9, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
    assert kept.columns == docs.columns
    assert Counter(map(tuple, kept.collect())) == {
        (1, "a b c d e f g"): 1, (1, "other words of another text"): 1, (None, "x y"): 1, (7, "x y z"): 1, (9, None): 2, (None, ""): 1
    }


def test_empty_documents(spark, empty):
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty, "").count() == 0, name

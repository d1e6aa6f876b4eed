import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import gru, toxicity
from pairloom.llm.toxicity import STRIDE, WINDOW, toxicity_scores, window_starts


def texts_and_labels(n, seed=3):
    """Clean words, and in toxic texts a few words with one of two stems."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(["ba", "re", "to", "ni", "la"]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.choice([20, 60, 150]))]
        toxic = i % 4 == 0
        for _ in range(rng.randrange(2, 5) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["zork", "quib"]) + rng.choice(["", "er", "ing", "os", "y", "em"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, small_training):
    rows, labels = texts_and_labels(600)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"score": F.lit("mine"), "label": F.lit(1)})
    scored = toxicity_scores(df, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert scored.columns == ["doc_id", "text", "label", "held_out", "score", "predicted"]
    got = scored.collect()
    assert len(got) == 600
    truth = dict(labels)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"]]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert len(held) > 100 and right / len(held) >= 0.9


def test_labels_that_are_held_out_are_not_used(spark, small_training):
    rows, labels = texts_and_labels(200)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    hidden = [(d, 1 - t if zlib.crc32(str(d).encode()) % 4 == 2 else t) for d, t in labels]
    scores = [
        {r["doc_id"]: r["score"] for r in toxicity_scores(df, spark.createDataFrame(x, "doc_id bigint, toxic int")).collect()}
        for x in (labels, hidden)
    ]
    assert scores[0] == pytest.approx(scores[1], abs=1e-6)


@pytest.fixture
def one_network(spark, small_training, monkeypatch):
    """Fits of one trained network to labels that miss three of ten toxic texts."""
    rows, labels = texts_and_labels(1200)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    network = toxicity.train_detector(df, spark.createDataFrame(labels, "doc_id bigint, toxic int"), "doc_id", "text", "toxic", 5).network
    monkeypatch.setattr(gru, "train", lambda *args: network)
    rng = random.Random(4)
    noisy = spark.createDataFrame([(d, int(t and rng.random() < 0.7)) for d, t in labels], "doc_id bigint, toxic int")

    def fit(**bounds):
        for name, bound in bounds.items():
            monkeypatch.setattr(toxicity, name, bound)
        detector = toxicity.train_detector(df, noisy, "doc_id", "text", "toxic", 5)
        return detector.probability(np.linspace(-6, 6, 25))

    return fit


def test_bounds_of_the_sample_keep_the_share_of_toxic_rows(one_network):
    whole = one_network()
    for bounds in ({"TRAIN_CLEAN": 150}, {"TRAIN_CLEAN": 10_000, "TRAIN_TOXIC": 60}):
        assert one_network(**bounds) == pytest.approx(whole, abs=0.12)


def test_probability_is_fitted_to_all_windows(spark, monkeypatch):
    """Also to those of long texts that the network was not trained on."""
    rows, labels = texts_and_labels(60)
    rows = [(d, " ".join(t for _, t in rows[d:] + rows[:d])) for d, _ in rows[:20]]
    network, seen = gru.Network.fresh(1), []
    monkeypatch.setattr(gru, "train", lambda *args: network)
    monkeypatch.setattr(toxicity, "_line", lambda x, *rest: seen.extend(x) or (1.0, 0.0))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    toxicity.train_detector(df, spark.createDataFrame(labels, "doc_id bigint, toxic int"), "doc_id", "text", "toxic", 5)
    want = []
    for d, text in rows:
        if zlib.crc32(str(d).encode()) % 4 != 2:
            words = gru.words_of(text)
            windows = gru.Windows([" ".join(words[s : s + WINDOW]) for s in window_starts(len(words))])
            assert len(windows.places) > 100
            want.append(gru.window_logits(network, network.project(windows.words), windows.places).max())
    assert sorted(seen) == pytest.approx(sorted(want), abs=1e-5)


def test_edge_cases(spark, docs, empty, small_training):
    rows, labels = texts_and_labels(120)
    more = spark.createDataFrame([(10_000 + d, t, "en", None, 1) for d, t in rows], docs.schema)
    marked = [(10_000 + d, t) for d, t in labels] + [(None, 1), (5, None), (6, 9), (10_000, 0)]
    table = spark.createDataFrame(marked, "doc_id bigint, toxic int")
    got = toxicity_scores(docs.unionByName(more), table).collect()
    assert len(got) == docs.count() + 120
    assert all(r["score"] == 0 and r["predicted"] == 0 for r in got if not (r["text"] or "").strip())
    assert all(not r["held_out"] for r in got if r["doc_id"] is None)
    assert toxicity_scores(empty, table).count() == 0
    for value in (0, 1):
        single = toxicity_scores(docs, spark.createDataFrame([(1, value)], "doc_id bigint, toxic int"))
        assert {r["score"] for r in single.collect()} <= {0.0, float(value)}


def test_windows_cover_and_overlap():
    for n in range(1, 400):
        starts = window_starts(n)
        assert starts[0] == 0 and starts[-1] + WINDOW >= n
        assert all(b - a == STRIDE for a, b in zip(starts, starts[1:]))
        assert all(s < n for s in starts)
    assert window_starts(0) == []


def test_gradients_match_differences():
    network = gru.Network.fresh(1)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    words, labels = ["alpha", "beta", "gamma", "delta"], np.array([1.0, 0, 1])
    places = np.array([[1, 2, 3, 0], [4, 1, 0, 0], [2, 2, 4, 1]])

    def loss():
        rows = np.vstack([network.project([]), network.inputs(words)[0] @ network.p["w"] + network.p["b"]])
        p = 1 / (1 + np.exp(-network.forward(rows, places)))
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for name, grad in network.gradients(words, places, labels).items():
        if isinstance(grad, tuple):
            row = grad[0][0]
            at, found = (row, 1), grad[1][grad[0] == row].sum(axis=0)[1]
        else:
            at = tuple(s // 2 for s in grad.shape)
            found = grad[at]
        old, step = network.p[name][at], 1e-3
        network.p[name][at] = old + step
        high = loss()
        network.p[name][at] = old - step
        low = loss()
        network.p[name][at] = old
        assert found == pytest.approx((high - low) / (2 * step), rel=0.05, abs=1e-6), name


def test_absent_steps_change_nothing():
    network = gru.Network.fresh(2)
    rows = network.project(["one", "two", "three"])
    short = network.forward(rows, np.array([[1, 2, 3]]))
    padded = network.forward(rows, np.array([[1, 2, 3, 0, 0, 0, 0]]))
    assert short == pytest.approx(padded, abs=1e-5)


def test_a_text_goes_to_the_task_once_and_in_parts(spark, monkeypatch):
    """Batches with all texts of a task, twice, took more memory than an executor has."""
    import pyarrow as pa

    seen = []

    class Scores:
        network = gru.Network.fresh(1)

        def probability(self, largest):
            return largest

    def logits(scorer, texts, count):
        found = np.array([float(len(t)) for t in texts])
        assert len(found) == count
        return found

    def strings(column):
        seen.append(len(column))
        return [text or "" for text in column.to_pylist()]

    monkeypatch.setattr(toxicity, "ROWS", 4)
    monkeypatch.setattr(toxicity, "_document_logits", logits)
    monkeypatch.setattr(toxicity, "strings", strings)
    texts = [None if i == 5 else "x" * i for i in range(10)]
    rows = pa.StructArray.from_arrays([pa.array(range(10)), pa.array(texts)], names=["doc_id", "text"])
    batch = pa.RecordBatch.from_arrays([rows, pa.array(range(10))], names=["_row", "_id"])
    got = list(toxicity._scored(Scores(), 1)(iter([batch])))
    assert [part.num_rows for part in got] == [4, 4, 2] == seen
    assert pa.Table.from_batches(got).drop_columns(["score"]).to_pylist() == batch.to_pylist()
    assert [s for part in got for s in part.column("score").to_pylist()] == [0 if t is None else len(t) for t in texts]

    # Column names as Spark resolves them; the text is no column beside the row.
    df = spark.createDataFrame([(1, "a b"), (2, None)], "DOC_ID bigint, Text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    scored = toxicity_scores(df, none)
    assert scored.columns == ["DOC_ID", "Text", "held_out", "score", "predicted"]
    assert [tuple(r)[:2] for r in scored.orderBy("DOC_ID").collect()] == [(1, "a b"), (2, None)]

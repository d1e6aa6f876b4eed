"""Toxicity of documents by a recurrent network over all their overlapping windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm import gru
from pairloom.llm.tokens import strings

# Words of a window, and from one window's start to the next.
WINDOW, STRIDE = 48, 24
# Bounds of the training sample: documents of either label, and windows of a document.
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_WINDOWS = 1500, 3000, 16
EPOCHS, STEPS = 6, 300
# Distinct words whose projections a task keeps.
KEPT_WORDS = 200_000
# Windows scored at once.
BATCH = 2048
# Rows handed back to Spark, and texts held in Python, at once.
ROWS = 1_000


@dataclass
class Detector:
    """A trained network, and the line that turns a document's largest logit into a probability.

    Without a network, which needs labels of both kinds, every score is ``base``.
    """

    network: gru.Network | None
    slope: float = 1.0
    shift: float = 0.0
    base: float = 0.0

    def probability(self, largest: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * largest + self.shift, -500, 500)))


def window_starts(words: int) -> list[int]:
    """Starts of the windows that cover so many words; none for none."""
    return list(range(0, max(1, words - (WINDOW - STRIDE)), STRIDE)) if words else []


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _training_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Evenly spaced windows of each document, at most ``TRAIN_WINDOWS``."""
    for batch in batches:
        docs, labels, places, texts = [], [], [], []
        for doc, label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strings(batch.column(2))):
            words = gru.words_of(text)
            starts = window_starts(len(words))
            if len(starts) > TRAIN_WINDOWS:
                starts = [starts[i * len(starts) // TRAIN_WINDOWS] for i in range(TRAIN_WINDOWS)]
            for start in starts:
                docs.append(doc)
                labels.append(label)
                places.append(start)
                texts.append(" ".join(words[start : start + WINDOW]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.int64()), pa.array(labels, pa.int32()), pa.array(places, pa.int64()), pa.array(texts, pa.string())],
            names=["doc", "label", "start", "words"],
        )


def train_detector(df: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, seed: int) -> Detector:
    """Fit a detector to a bounded sample of the labelled rows that are not held out.

    The sample is the ``TRAIN_TOXIC`` and ``TRAIN_CLEAN`` first rows of either label in the
    order of a hash of the id. At most ``TRAIN_WINDOWS`` windows of each reach the driver, where the network
    is trained; then tasks read the sampled rows again and give the largest logit of all windows of each,
    the number that a score is made of. In the fit of the probability a row stands for
    the labels of its kind that the bound left out, so that the share of toxic rows is that of all labels.
    """
    known = labels.select(F.col(doc_id).cast("long").alias("doc"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("doc").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc")))
    # Two rows at most.
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    bounds = {1: TRAIN_TOXIC, 0: TRAIN_CLEAN}
    picked = [
        known.filter(F.col("label") == value).orderBy(F.xxhash64("doc", F.lit(seed)), "doc").limit(bound)
        for value, bound in bounds.items()
    ]
    # Bounded by the limits; an id with several labels is left out.
    sample = picked[0].unionByName(picked[1]).groupBy("doc").agg(F.min("label").alias("label"), F.max("label").alias("high"))
    sample = F.broadcast(sample.filter(F.col("label") == F.col("high")).drop("high"))
    chosen = df.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).join(sample, "doc")
    rows = chosen.select("doc", "label", "text").mapInArrow(_training_windows, "doc bigint, label int, start bigint, words string")
    # Sorted here, where it is bounded: a sort in Spark would cut the windows twice to sample its ranges.
    found = rows.toArrow().sort_by([("doc", "ascending"), ("start", "ascending"), ("words", "ascending")])
    docs, truth = found.column("doc").to_numpy(), found.column("label").to_numpy()
    toxic = truth.sum()
    if toxic in (0, len(truth)):
        return Detector(None, base=float(toxic > 0))
    windows = gru.Windows(found.column("words").to_pylist())
    network = gru.train(windows, docs, truth, seed, EPOCHS, STEPS)
    largest = chosen.select("doc", "label", "text").mapInArrow(_largest_logits(network), "doc bigint, label int, largest double")
    # One number a document, of as many as were sampled.
    found = largest.toArrow().sort_by([("doc", "ascending"), ("largest", "ascending")])
    truth = found.column("label").to_numpy()
    stands_for = {value: max(1.0, totals.get(value, 0) / bound) for value, bound in bounds.items()}
    weights = np.where(truth == 1, stands_for[1], stands_for[0])
    return Detector(network, *_line(found.column("largest").to_numpy(), truth, weights))


def _largest_logits(network: gru.Network):
    """(document, label, largest logit of all windows) of texts with any word."""

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(network)
        for batch in batches:
            logits = _document_logits(scorer, _texts(batch.column("text")), batch.num_rows)
            found = batch.drop_columns(["text"]).append_column("largest", pa.array(logits, pa.float64()))
            yield found.filter(pa.array(~np.isinf(logits)))

    return largest


def _line(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one value of weighted rows, by damped Newton steps with a little ridge."""
    weights = weights / weights.mean()
    center, spread = x.mean(), x.std() or 1.0
    z = np.stack([(x - center) / spread, np.ones(len(x))], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (weights * (p - y)) + 0.1 * beta
        hessian = (z * (weights * p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2)
        beta -= np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    slope = max(beta[0], 1e-3) / spread
    return float(slope), float(beta[1] - slope * center)


class Scorer:
    """Logits of windows, with the projections of words met before."""

    def __init__(self, network: gru.Network):
        self.network = network
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = self.network.project([])
        self.used = 1

    def places(self, words: list[str]) -> np.ndarray:
        """Row of each word; may empty what is known, so that rows of earlier calls no longer hold."""
        missing = list({w for w in words if w not in self.known})
        if missing:
            self._add(missing)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def crowded(self) -> bool:
        return len(self.known) > KEPT_WORDS

    def _add(self, words: list[str]) -> None:
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            need = self.used + len(part)
            if need > len(self.rows):
                grown = np.zeros((max(need, 2 * len(self.rows)), self.rows.shape[1]), np.float32)
                grown[: self.used] = self.rows[: self.used]
                self.rows = grown
            self.rows[self.used : need] = self.network.project(part)[1:]
            self.known.update(zip(part, range(self.used, need)))
            self.used = need

    def logits(self, windows: list[np.ndarray]) -> np.ndarray:
        places = np.zeros((len(windows), WINDOW), np.int64)
        for i, window in enumerate(windows):
            places[i, : len(window)] = window
        return gru.window_logits(self.network, self.rows, places, BATCH)


def _texts(column: pa.Array) -> Iterator[str]:
    """Texts of a column, ``ROWS`` of them in Python at a time: a batch may hold all texts of a task."""
    for at in range(0, len(column), ROWS):
        yield from strings(column.slice(at, ROWS))


def _scored(detector: Detector, place: int):
    """Append a score to rows whose text is field ``place`` of the first column."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(detector.network) if detector.network else None
        for batch in batches:
            texts = batch.column(0).field(place)
            if scorer is None:
                scores = np.full(len(texts), detector.base)
            else:
                largest = _document_logits(scorer, _texts(texts), len(texts))
                scores = np.where(np.isinf(largest), 0.0, detector.probability(largest))
            for at in range(0, batch.num_rows, ROWS):
                yield batch.slice(at, ROWS).append_column("score", pa.array(scores[at : at + ROWS], pa.float64()))

    return score


def _document_logits(scorer: Scorer, texts: Iterator[str], count: int) -> np.ndarray:
    """Logit of each of ``count`` texts: that of its likeliest window, minus infinity without any word."""
    largest = np.full(count, -np.inf)
    owners: list[int] = []
    windows: list[np.ndarray] = []

    def flush() -> None:
        if windows:
            np.maximum.at(largest, owners, scorer.logits(windows))
            owners.clear()
            windows.clear()
        if scorer.crowded():
            scorer._reset()

    for i, text in enumerate(texts):
        words = gru.words_of(text)
        places = scorer.places(words) if words else np.zeros(0, np.int64)
        for start in window_starts(len(words)):
            owners.append(i)
            windows.append(places[start : start + WINDOW])
            if len(windows) >= 4 * BATCH:
                np.maximum.at(largest, owners, scorer.logits(windows))
                owners.clear()
                windows.clear()
        if len(windows) >= BATCH or scorer.crowded():
            flush()
    flush()
    return largest


def toxicity_scores(
    df: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    threshold: float = 0.3,
    seed: int = 5,
) -> DataFrame:
    """All rows and columns of ``df`` with ``held_out``, ``score`` (0 to 1) and ``predicted``.

    The whole text is read in overlapping windows of 48 words, and the likeliest window
    decides. Labels are learned from rows that are not held out, joined by id; the score
    itself comes from the text alone, so copies get one score. A text without letters, or null, scores 0.
    Null ids are scored and not held out. Without labels of both kinds every score is the one label there is, or 0. An empty
    table gives an empty result. Input columns with an added name are replaced.
    """
    detector = train_detector(df, labels, doc_id, text, label, seed)
    # A text is long: it goes to the task once, as a field of its row.
    rows = df.select(F.struct("*").alias("_row"), F.col(doc_id).cast("long").alias("_id"))
    place = df.columns.index(text) if text in df.columns else [c.lower() for c in df.columns].index(text.lower())
    keep = [c for c in df.columns if c.lower() not in {"held_out", "score", "predicted"}]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", score double"
    scored = rows.mapInArrow(_scored(detector, place), ddl)
    return scored.select(
        *[F.col("_row").getField(c).alias(c) for c in keep],
        held_out(F.col("_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )

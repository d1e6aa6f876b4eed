"""A small bidirectional gated recurrent network with attention pooling, in numpy.

Input of a step is a word: an embedding of the whole word beside the mean embedding of its
character runs, both in hashed tables. Two recurrent layers read the window in either direction, a
soft attention pools their states, and one linear unit gives the logit of the window.

``Featurizer`` turns words into rows of input projections once per distinct word, which
is all that the recurrent layers need; ``Network`` holds the parameters, the forward pass over such
rows, and the gradients for training.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

WORD_ROWS, RUN_ROWS = 1 << 14, 1 << 15
WORD_DIM, RUN_DIM, HIDDEN, ATTENTION = 8, 12, 12, 8
#: Lengths of the character runs, in UTF-8 bytes, with one mark before and behind a word.
RUNS = (4, 6)
#: Words whose vectors are made at once.
PROJECTED = 10_000
#: Longest word that is told from its beginning; longer ones are read in parts of this length.
LONGEST_WORD = 40

_LETTERS = re.compile(r"[^\W\d_]+")
# Update gate of an absent step: keeps the state as it was.
_KEEP = 30.0


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters; very long runs in parts."""
    words = _LETTERS.findall(text.lower())
    if any(len(w) > LONGEST_WORD for w in words):
        words = [w[i : i + LONGEST_WORD] for w in words for i in range(0, len(w), LONGEST_WORD)]
    return words


def _hash(values: np.ndarray, rows: int) -> np.ndarray:
    mixed = values * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % rows


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each word in the word table; rows of all its runs in the run table, and where each word's begin."""
    raw = [b"\x02" + w.encode() + b"\x03" for w in words]
    lengths = np.array([len(r) for r in raw])
    # Zeros behind each word, so that a run never reaches into the next.
    pad = max(RUNS)
    data = np.frombuffer((b"\0" * pad).join(raw) + b"\0" * pad, np.uint8).astype(np.uint64)
    starts = np.r_[0, np.cumsum(lengths + pad)[:-1]]
    inside = np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
    runs = []
    for n in RUNS:
        code = np.zeros(len(inside), np.uint64)
        for i in range(n):
            code |= data[inside + i] << np.uint64(8 * i)
        runs.append(_hash(code + np.uint64(n << 56), RUN_ROWS))
    # Both lengths begin at every byte: two rows a byte, those of a word together.
    rows = np.stack(runs, axis=1).reshape(-1)
    whole = np.zeros(len(words), np.uint64)
    powers = np.full(int(lengths.max()) + 1, 0x100000001B3, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    place = np.arange(lengths.sum()) - np.repeat(np.r_[0, np.cumsum(lengths)[:-1]], lengths)
    terms = data[inside] * powers[place]
    whole = np.add.reduceat(terms, np.r_[0, np.cumsum(lengths)[:-1]])
    return _hash(whole, WORD_ROWS), rows, len(RUNS) * np.r_[0, np.cumsum(lengths)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        inputs = WORD_DIM + RUN_DIM

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        return cls(
            {
                "word": normal(WORD_ROWS, WORD_DIM, scale=0.1),
                "run": normal(RUN_ROWS, RUN_DIM, scale=0.3),
                # Columns: update, reset and new state of the forward layer, then of the backward one.
                "w": normal(inputs, 6 * HIDDEN, scale=inputs**-0.5),
                "b": np.zeros(6 * HIDDEN, np.float32),
                "uf": normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
                "ub": normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
                "a": normal(2 * HIDDEN, ATTENTION, scale=(2 * HIDDEN) ** -0.5),
                "v": normal(ATTENTION, scale=ATTENTION**-0.5),
                "o": normal(2 * HIDDEN, scale=(2 * HIDDEN) ** -0.5),
                "c": np.zeros(1, np.float32),
            }
        )

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """Input vectors of the words, and the table rows they are made of."""
        word_rows, run_rows, bounds = features(words)
        means = np.add.reduceat(self.p["run"][run_rows], bounds[:-1], axis=0) / np.diff(bounds)[:, None]
        return np.concatenate([self.p["word"][word_rows], means.astype(np.float32)], axis=1), (word_rows, run_rows, bounds)

    def project(self, words: list[str]) -> np.ndarray:
        """What the words contribute to all gates: row 0 for an absent word, then one row a word."""
        rows = np.zeros((len(words) + 1, 6 * HIDDEN), np.float32)
        rows[0, :HIDDEN] = rows[0, 3 * HIDDEN : 4 * HIDDEN] = _KEEP
        for at in range(0, len(words), PROJECTED):
            part = self.inputs(words[at : at + PROJECTED])[0] @ self.p["w"] + self.p["b"]
            rows[at + 1 : at + 1 + len(part)] = part
        return rows

    def _layer(self, projected: np.ndarray, places: np.ndarray, side: int, kept: list | None) -> np.ndarray:
        """States of one direction, (steps, windows, hidden)."""
        u, h3 = self.p["ub" if side else "uf"], 3 * HIDDEN
        rows = projected[:, side * h3 : (side + 1) * h3]
        n, steps = places.shape
        states = np.empty((steps, n, HIDDEN), np.float32)
        h = np.zeros((n, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1) if side else range(steps):
            x, inner = rows[places[:, t]], h @ u
            gates = _sigmoid(x[:, : 2 * HIDDEN] + inner[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(x[:, 2 * HIDDEN :] + r * inner[:, 2 * HIDDEN :])
            if kept is not None:
                kept.append((t, h, z, r, new, inner[:, 2 * HIDDEN :]))
            h = new + z * (h - new)
            states[t] = h
        return states

    def forward(self, projected: np.ndarray, places: np.ndarray, keep: bool = False):
        """Logit of each window; ``places`` (windows, steps) are rows of ``projected``, 0 where absent."""
        kept = ([], []) if keep else (None, None)
        states = np.concatenate([self._layer(projected, places, side, kept[side]) for side in (0, 1)], axis=2)
        hidden = np.tanh(states @ self.p["a"])
        scores = hidden @ self.p["v"]
        scores[places.T == 0] = -1e9
        scores -= scores.max(axis=0)
        weights = np.exp(scores)
        weights /= weights.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weights, states)
        logits = pooled @ self.p["o"] + self.p["c"][0]
        return (logits, (kept, states, hidden, weights, pooled)) if keep else logits

    def gradients(self, words: list[str], places: np.ndarray, labels: np.ndarray) -> dict[str, object]:
        """Gradients of the mean cross entropy; those of tables as (rows, values)."""
        x, (word_rows, run_rows, bounds) = self.inputs(words)
        projected = np.zeros((len(words) + 1, 6 * HIDDEN), np.float32)
        projected[0, :HIDDEN] = projected[0, 3 * HIDDEN : 4 * HIDDEN] = _KEEP
        projected[1:] = x @ self.p["w"] + self.p["b"]
        logits, (kept, states, hidden, weights, pooled) = self.forward(projected, places, keep=True)
        d_logit = ((_sigmoid(logits) - labels) / len(labels)).astype(np.float32)
        grads: dict[str, object] = {"o": pooled.T @ d_logit, "c": np.array([d_logit.sum()], np.float32)}
        d_pooled = np.outer(d_logit, self.p["o"])
        d_states = weights[:, :, None] * d_pooled
        d_weights = np.einsum("nh,tnh->tn", d_pooled, states)
        d_scores = weights * (d_weights - (weights * d_weights).sum(axis=0))
        grads["v"] = np.einsum("tn,tna->a", d_scores, hidden)
        d_hidden = d_scores[:, :, None] * self.p["v"] * (1 - hidden * hidden)
        grads["a"] = np.einsum("tnh,tna->ha", states, d_hidden)
        d_states += d_hidden @ self.p["a"].T
        d_projected = np.zeros_like(projected)
        for side in (0, 1):
            u = self.p["ub" if side else "uf"]
            du, dh = np.zeros_like(u), np.zeros((places.shape[0], HIDDEN), np.float32)
            gates = np.empty((places.shape[1], places.shape[0], 3 * HIDDEN), np.float32)
            for t, before, z, r, new, inner in reversed(kept[side]):
                dh = dh + d_states[t][:, side * HIDDEN : (side + 1) * HIDDEN]
                d_new = dh * (1 - z) * (1 - new * new)
                d_z = dh * (before - new) * z * (1 - z)
                d_r = d_new * inner * r * (1 - r)
                d_inner = np.concatenate([d_z, d_r, d_new * r], axis=1)
                du += before.T @ d_inner
                gates[t] = np.concatenate([d_z, d_r, d_new], axis=1)
                dh = dh * z + d_inner @ u.T
            grads["ub" if side else "uf"] = du
            columns = slice(side * 3 * HIDDEN, (side + 1) * 3 * HIDDEN)
            d_projected[:, columns] = _summed(places.T.reshape(-1), gates.reshape(-1, 3 * HIDDEN), len(projected))
        d_rows = d_projected[1:]
        grads["w"], grads["b"] = x.T @ d_rows, d_rows.sum(axis=0)
        dx = d_rows @ self.p["w"].T
        grads["word"] = (word_rows, dx[:, :WORD_DIM])
        counts = np.diff(bounds)
        grads["run"] = (run_rows, np.repeat(dx[:, WORD_DIM:] / counts[:, None], counts, axis=0))
        return grads


def _summed(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sum of the values of equal rows."""
    out = np.zeros((size, values.shape[1]), np.float32)
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    out[ordered[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


class Adam:
    """Adam; rows of tables that a step does not touch are left alone."""

    def __init__(self, network: Network, rate: float):
        self.network, self.rate, self.step = network, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in network.p.items()}
        self.s = {k: np.zeros_like(v) for k, v in network.p.items()}

    def apply(self, grads: dict[str, object]) -> None:
        self.step += 1
        bias = np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for name, grad in grads.items():
            if isinstance(grad, tuple):
                rows, places = np.unique(grad[0], return_inverse=True)
                grad, at = _summed(places, grad[1], len(rows)), rows
            else:
                at = slice(None)
            self.m[name][at] = 0.9 * self.m[name][at] + 0.1 * grad
            self.s[name][at] = 0.999 * self.s[name][at] + 0.001 * grad * grad
            self.network.p[name][at] -= self.rate * bias * self.m[name][at] / (np.sqrt(self.s[name][at]) + 1e-8)


class Windows:
    """Windows of documents as rows of word places, 0 where a window is shorter than the longest."""

    def __init__(self, texts: list[str]):
        vocabulary: dict[str, int] = {}
        rows = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in t.split(" ")], np.int32) for t in texts]
        self.places = np.zeros((len(rows), max(map(len, rows), default=1)), np.int32)
        for i, row in enumerate(rows):
            self.places[i, : len(row)] = row
        self.words = list(vocabulary)


def train(windows: Windows, doc: np.ndarray, label: np.ndarray, seed: int, epochs: int, steps: int, batch: int = 256) -> Network:
    """Fit to windows of labelled documents; ``doc`` and ``label`` are those of each window.

    Only some windows of a document of label 1 show why. The first epoch takes all of them; after that the
    two that the network finds likeliest stand for the document. Windows of label 0 all
    count, three for each of label 1. There are ``epochs`` epochs, and more until there were ``steps`` steps.
    """
    rng = np.random.default_rng(seed)
    network = Network.fresh(seed)
    adam = Adam(network, 0.01)
    places, names = windows.places, windows.words
    label = label.astype(np.float32)
    positive, negative = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    batch = max(32, min(batch, 4 * len(np.unique(doc[positive]))))
    epoch = 0
    while epoch < epochs or adam.step < steps:
        chosen = positive
        if epoch:
            logits = window_logits(network, network.project(names), places[positive])
            order = np.lexsort((-logits, doc[positive]))
            ranked = doc[positive][order]
            first = np.r_[True, ranked[1:] != ranked[:-1]]
            chosen = positive[order[first | np.r_[False, first[:-1]]]]
        others = rng.permutation(negative)[: 3 * len(chosen)]
        rows = rng.permutation(np.r_[chosen, others])
        for at in range(0, len(rows), batch):
            own = rows[at : at + batch]
            used, local = np.unique(places[own], return_inverse=True)
            local = local.reshape(len(own), -1)
            if used[0] != 0:
                used, local = np.r_[0, used], local + 1
            adam.apply(network.gradients([names[i - 1] for i in used[1:]], local, label[own]))
        epoch += 1
    return network


def window_logits(network: Network, projected: np.ndarray, places: np.ndarray, batch: int = 2048) -> np.ndarray:
    parts = [network.forward(projected, places[at : at + batch]) for at in range(0, len(places), batch)]
    return np.concatenate(parts) if parts else np.zeros(0, np.float32)

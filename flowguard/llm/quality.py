"""Quality rules: counts that reject plain junk, and a calibrated n-gram classifier for the rest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.llm import hashed
from flowguard.llm.common import carried

BITS = 15
#: A document is kept when its calibrated probability of good quality reaches this: only clear cases are rejected.
LEAST_GOOD = 0.2
WINDOW, FEWEST_WORDS, MOST_REPEATED = 8, 20, 30
_SPACES, _SYMBOLS = " \t\n\r\x0b\x0c", "#*$%&|<>"
#: Digits count alike.
_DIGITS = bytes(48 if 48 <= c <= 57 else c for c in range(256))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words that occurs at least twice in the text."""
    if len(words) <= window:
        return 0
    seen: dict[bytes, int] = {}
    codes = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    span = 1
    while span < window:  # codes of runs twice as long, by pairs of codes
        codes = codes[:-span] * (int(codes.max()) + 1) + codes[span:]
        codes = np.unique(codes, return_inverse=True)[1]
        span *= 2
    twice = np.flatnonzero(np.bincount(codes)[codes] > 1)
    if not len(twice):
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; a null text has none."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "replace").split()  # bytes split at exactly the six ASCII white spaces
    earlier: set[str] = set()
    repeated = 0
    for line in text.split("\n"):
        if line in earlier:
            repeated += 1
        elif line.strip(_SPACES):
            earlier.add(line)
    return (len(words), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)), repeated, repeated_words(words))


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < FEWEST_WORDS or 100 * n_repeat_words > MOST_REPEATED * n_words


@dataclass
class Model:
    """A text's evidence is the sum, over its kinds of n-grams, of the mean weight of its slots."""
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def good(self, text: str) -> float:
        """Calibrated probability of good quality."""
        z = self.bias
        for i, g in enumerate(_groups(text)):
            if len(g):
                z += float(np.take(self.weights, g + np.uint32(i << BITS)).mean(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -40, 40))))


def _groups(text: str) -> list[np.ndarray]:
    data = text.encode("utf-8", "replace").translate(_DIGITS)
    words = hashed.word_hashes(data)
    return [hashed.byte_grams(data, 2, BITS), hashed.byte_grams(data, 4, BITS), hashed.word_grams(words, 1, BITS), hashed.word_grams(words, 2, BITS)]


def fit(features: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, weight: np.ndarray, epochs: int = 12, rate: float = 0.5, seed: int = 5) -> Model:
    """Logistic regression by AdaGrad on four fifths of the rows, Platt scaling on the last fifth with the rows' weights.

    With one class only, or no rows, the model says 1 for everything.
    """
    weights, bias = np.zeros(4 << BITS, np.float32), 0.0
    if len(set(good.tolist())) < 2 or len(good) < 10:
        return Model(weights, 40.0, 1.0, 0.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(good))
    held, train = order[:len(order) // 5], order[len(order) // 5:]
    squares, bias_square = np.full(len(weights), 1e-8, np.float32), 1e-8
    for _ in range(epochs):
        for i in rng.permutation(train):
            slots, share = features[i]
            z = float(share @ weights[slots]) + bias
            error = 1 / (1 + np.exp(-z)) - good[i]
            step = np.float32(error) * share
            squares[slots] += step * step
            weights[slots] -= np.float32(rate) * step / np.sqrt(squares[slots])
            bias_square += error * error
            bias -= rate * error / np.sqrt(bias_square)
    z = np.array([float(features[i][1] @ weights[features[i][0]]) + bias for i in held])
    a, b = _platt(z, good[held].astype(float), weight[held])
    return Model(weights, float(bias), a, b)


def _platt(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and shift that minimise the weighted log loss, by damped Newton steps; targets are smoothed as Platt does."""
    positive, negative = (w * y).sum(), (w * (1 - y)).sum()
    if not positive or not negative:
        return 1.0, 0.0
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, beta = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        gradient = x.T @ (w * (p - t)) + 1e-6 * beta
        curve = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        beta = beta - np.clip(np.linalg.solve(curve, gradient), -2, 2)
    return float(beta[0]), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", identity: str = "doc_id", quality: str = "quality",
          per_label: int = 2000, seed: int = 5) -> Model:
    """Fit on about `per_label` labelled rows of either quality, chosen by hash; documents without a label are not read.

    The chosen ids are bounded by `per_label` and are therefore broadcast.
    """
    chosen = hashed.labelled_sample(labels.where(F.col(quality).isin(0, 1)).select(identity, quality), quality, identity, per_label, 2, seed)
    rows = docs.where(F.col(text).isNotNull()).select(identity, text).join(F.broadcast(chosen), identity)
    found = hashed.collect_features(rows, text, [identity, quality, "weight"], _groups, 1 << BITS)
    features, good = hashed.as_arrays(found), np.array(found.column(quality).to_pylist(), dtype=int)
    ids, weight = found.column(identity).to_pylist(), np.array(found.column("weight").to_pylist(), dtype=float)
    order = sorted(range(len(ids)), key=lambda i: (ids[i], good[i], len(features[i][0])))
    return fit([features[i] for i in order], good[order], weight[order], seed=seed)


def judge(docs: DataFrame, model: Model, text: str = "text", carry: tuple[str, ...] = ("doc_id",), least: float = LEAST_GOOD) -> DataFrame:
    """`carry` columns with the five counts, `base_failed`, `kept` and `good` (calibrated probability) for every row.

    Whole texts are read, null texts as empty ones. Texts that fail the base rules are not kept and have no probability.
    Repeated rows get equal answers; an empty table gives an empty result.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    made = [*counts, "base_failed", "kept", "good"]
    rows, at, held, kinds = carried(docs, text, carry, made)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights
    schema = ", ".join(kinds + [f"{c} long" for c in counts]
                       + ["base_failed boolean", "kept boolean", "good double"])
    names = [*held, *made]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = [measure(t) for t in texts]
            failed = [base_failed(m[0], m[4]) for m in found]
            good = [None if f else shared.value.good(t) for t, f in zip(texts, failed, strict=True)]
            columns = [pa.array([m[i] for m in found], pa.int64()) for i in range(len(counts))]
            columns += [pa.array(failed, pa.bool_()), pa.array([g is not None and g >= least for g in good], pa.bool_()), pa.array(good, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(held))), *columns], names=names)
    return rows.mapInArrow(score, schema)

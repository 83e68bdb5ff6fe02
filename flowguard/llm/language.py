"""Language identification by averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.llm import hashed
from flowguard.llm.common import carried

BITS, SIZES = 14, (2, 3, 4)
_PLAIN_LETTER = re.compile(r"[A-Za-z]")
#: ASCII bytes that are no letters become spaces.
_LETTERS_ONLY = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


@dataclass
class Model:
    """Logits are the mean over a text's subwords of `table[slot]`, plus `bias`, divided by `temperature`."""
    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, and whether it reaches the rejection threshold."""
        if text is None or not self.labels or not (_PLAIN_LETTER.search(text) or any(map(str.isalpha, text))):
            return "und", 0.0, False
        groups = _groups(text)
        logits = self.bias.astype(np.float64)
        for i, g in enumerate(groups):
            if len(g):
                logits = logits + np.take(self.table, g + np.uint32(i << BITS), axis=0).mean(axis=0, dtype=np.float64)
        p = _softmax(logits / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best]), bool(p[best] >= self.least)


def _groups(text: str) -> list[np.ndarray]:
    data = b" " + text.lower().encode("utf-8", "replace").translate(_LETTERS_ONLY) + b" "
    return [hashed.byte_grams(data, n, BITS) for n in SIZES]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


Features = list[tuple[np.ndarray, np.ndarray]]


def _descend(features: Features, y: np.ndarray, rows: np.ndarray, classes: int, dim: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Logits per slot and class, and the bias, by stochastic gradient descent. Slots that no row showed say nothing."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (len(SIZES) << BITS, dim)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (dim, classes)).astype(np.float32), np.zeros(classes, np.float32)
    steps, done, seen = max(1, epochs * len(rows)), 0, np.zeros(len(embed), bool)
    for i in rows:
        seen[features[i][0]] = True
    for _ in range(epochs):
        for i in rng.permutation(rows):
            slots, share = features[i]
            lr, done = rate * (1 - done / steps), done + 1
            if not len(slots):
                continue
            held = embed[slots]
            hidden = share @ held
            error = _softmax(hidden @ out + bias)
            error[y[i]] -= 1
            back = out @ error
            out -= np.float32(lr * 0.1) * np.outer(hidden, error)
            bias -= np.float32(lr * 0.01) * error
            embed[slots] = held - np.float32(lr) * share[:, None] * back
    return np.where(seen[:, None], embed @ out, np.float32(0)), bias


def _logits(table: np.ndarray, bias: np.ndarray, features: Features, rows: np.ndarray) -> np.ndarray:
    return np.array([(share @ table[slots] if len(slots) else 0) + bias for slots, share in (features[i] for i in rows)]).reshape(len(rows), len(bias))


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor, 1 at least, of least log loss against smoothed targets: a class of n rows is right in (n + 1) of (n + classes)
    cases, so rows that the logits tell apart without an error do not make every answer certain."""
    if not len(y):
        return 1.0
    classes = logits.shape[1]
    n = np.bincount(y, minlength=classes)[y][:, None]
    target = np.full(logits.shape, 1.0) / (n + classes)
    target[np.arange(len(y)), y] = ((n + 1) / (n + classes))[:, 0]

    def loss(t: float) -> float:
        return float(-(target * np.log(_softmax(logits / t) + 1e-300)).sum(axis=1).mean())
    return float(min(np.geomspace(1, 1000, 241), key=loss))


def _content(features: Features, labels: list[str]) -> list[int]:
    """Places of the rows in an order that depends on nothing but the rows."""
    return sorted(range(len(labels)), key=lambda i: (labels[i], hashlib.sha256(features[i][0].tobytes() + features[i][1].tobytes()).digest()))


def fit(features: Features, labels: list[str], dim: int = 16, epochs: int = 8, rate: float = 4.0, precision: float = 0.99, seed: int = 5, left_out: int = 4) -> Model:
    """Gradient descent on four fifths of the rows; temperature and rejection threshold by the last fifth.

    The temperature fits the probabilities to smoothed targets. What an unknown language looks like is learned by leaving
    known ones out: the languages are dealt into `left_out` groups, and a model that was fitted without a group scores it. The
    threshold parts the right answers of the last fifth from these as well as can be, and is no lower than the least
    probability at which `precision` of the accepted rows of the last fifth are right. The same rows in any order give the
    same model. Without rows, or with a single language, nothing can be told: every text is `und`, or is not accepted.
    """
    names = sorted(set(labels))
    if not names:
        return Model([], np.zeros((1, 1), np.float32), np.zeros(1), 1.0, 1.0)
    order = _content(features, labels)
    features, y = [features[i] for i in order], np.array([names.index(labels[i]) for i in order])
    mixed = np.random.default_rng(seed).permutation(len(y))
    held, rows = mixed[:len(y) // 5], mixed[len(y) // 5:]
    table, bias = _descend(features, y, rows, len(names), dim, epochs, rate, seed)
    logits = _logits(table, bias, features, held)
    temperature = _temperature(logits, y[held])
    p = _softmax(logits / temperature)
    top, right = p.max(axis=1, initial=0), p.argmax(axis=1) == y[held]
    strange = []
    for group in range(min(left_out, len(names)) if len(names) > 2 else 0):
        out = np.arange(len(names)) % min(left_out, len(names)) == group
        kept = np.cumsum(~out) - 1  # numbers of the remaining languages
        inside = rows[~out[y[rows]]]
        other = _descend(features, np.where(out[y], 0, kept[y]), inside, int((~out).sum()), dim, epochs, rate, seed)
        known = held[~out[y[held]]]
        scale = _temperature(_logits(*other, features, known), kept[y[known]])
        strange.append(_softmax(_logits(*other, features, np.flatnonzero(out[y])) / scale).max(axis=1, initial=0))
    least = _threshold(top, right, np.concatenate(strange) if strange else np.zeros(0), precision)
    return Model(names, table, bias, temperature, least)


def _threshold(top: np.ndarray, right: np.ndarray, strange: np.ndarray, precision: float) -> float:
    if not right.any():
        return 1.0
    ranks = np.argsort(-top, kind="stable")
    good = np.cumsum(right[ranks]) / np.arange(1, len(top) + 1) >= precision
    least = float(top[ranks][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    if not len(strange):
        return least
    marks = np.unique(np.concatenate([top[right], strange]))
    sure, odd = np.sort(top[right]), np.sort(strange)
    apart = np.searchsorted(odd, marks) / len(odd) - np.searchsorted(sure, marks) / len(sure)
    at = int(apart.argmax())
    # Half way between the two scores that the best cut lies between.
    return max(least, float((marks[at] + marks[max(0, at - 1)]) / 2))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", identity: str = "doc_id", per_label: int = 1000,
          labels: int = 200, seed: int = 5) -> Model:
    """Fit on a bounded sample: about `per_label` rows of each of the `labels` most frequent languages."""
    sample = hashed.labelled_sample(labelled.where(F.col(text).isNotNull()), lang, identity, per_label, labels, seed)
    found = hashed.collect_features(sample, text, [identity, lang], _groups, 1 << BITS)
    rows = hashed.as_arrays(found)
    names = found.column(lang).to_pylist()
    order = sorted(range(len(rows)), key=lambda i: (str(found.column(identity)[i]), names[i], len(rows[i][0])))
    return fit([rows[i] for i in order], [names[i] for i in order], seed=seed)


def identify(docs: DataFrame, model: Model, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`carry` columns with `lang_pred`, `score` (calibrated probability) and `accepted` for every row.

    Whole texts are read. A text that is null or without a letter is `und` with score 0 and not accepted, as is every
    text where nothing was learned. Repeated rows get equal answers; an empty table gives an empty result.
    """
    made = ["lang_pred", "score", "accepted"]
    rows, at, kept, kinds = carried(docs, text, carry, made)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as many rows as slots, one column per language
    schema = ", ".join(kinds + ["lang_pred string", "score double", "accepted boolean"])
    names = [*kept, *made]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = [shared.value.predict(t) for t in batch.column(at).to_pylist()]
            columns = [pa.array([a[i] for a in answers], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *columns], names=names)
    return rows.mapInArrow(score, schema)

"""Text quality by a factorisation machine.

Features are hashed words (their share of the text), statistics of the text's structure, and the
length as metadata.  The score is

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),

the sum-of-squares identity for all pairwise interactions with factors of rank ``RANK``, so it
takes time in proportion to the number of features.  Training runs in numpy on the driver on a
sample of labelled rows that is bounded in rows and bytes.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._labels import Adam, labelled, sigmoid
from ._shared import text_slices, utf8

BUCKETS = 1 << 14
RANK = 6
EPOCHS = 12
BATCH = 128
RATE = 0.01
DECAY = 1e-4
_CACHED_WORDS, _CACHED_BYTES = 300_000, 64
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_MARKS = b"!?*&%$#|<>{}[]=_~^@\\/+"

STATISTICS = (
    "words", "word_length", "distinct_words", "repeated_neighbours", "lines", "distinct_lines", "words_a_line",
    "upper", "digits", "marks", "marked_words", "symbol_words", "stops", "bytes_over_127", "length",
)


class _Buckets(dict):
    """Buckets of words; short ones are remembered, so that memory is bounded in bytes."""

    def __missing__(self, word: bytes) -> int:
        value = zlib.crc32(word.lower().strip(b".,;:!?*&%$#")) % BUCKETS
        if len(word) <= _CACHED_BYTES:
            if len(self) >= _CACHED_WORDS:
                self.clear()
            self[word] = value
        return value


def _share(text: bytes, characters: bytes) -> float:
    return (len(text) - len(text.translate(None, characters))) / max(1, len(text))


def features(text: bytes, buckets: _Buckets) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Buckets of a text's words, their values (of length 1 together), and the statistics."""
    words = text.split()
    counts = Counter(words)
    n, lines = max(1, len(words)), [x for x in text.split(b"\n") if x]
    marked = sum(c for w, c in counts.items() if w[-1] in _MARKS)
    symbols = sum(c for w, c in counts.items() if not w.isalnum() and len(w.strip(_MARKS)) == 0)
    statistics = [
        np.log1p(len(words)),
        sum(len(w) * c for w, c in counts.items()) / n,
        len(counts) / n**0.8,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        np.log1p(len(lines)),
        len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))),
        _share(text, _UPPER),
        _share(text, _DIGITS),
        _share(text, _MARKS),
        marked / n,
        symbols / n,
        _share(text, b".") * 50,
        1 - len(text.decode()) / max(1, len(text)),
        np.log1p(len(text)),
    ]
    hashed: Counter = Counter()
    for word, c in counts.items():
        hashed[buckets[word]] += c
    at = np.fromiter(hashed.keys(), dtype=np.int64, count=len(hashed))
    values = np.sqrt(np.fromiter(hashed.values(), dtype=np.float64, count=len(hashed)))
    return at, values / max(1e-9, np.sqrt((values * values).sum())), statistics


@dataclass
class Model:
    """The machine's weights; ``weights`` is None where the labels had one class only."""

    weights: np.ndarray | None
    factors: np.ndarray | None
    bias: float
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None

    def logit(self, at: np.ndarray, values: np.ndarray, statistics: list[float]) -> float:
        if self.weights is None:
            return self.bias
        at, x = _row(at, values, (np.array(statistics) - self.mean) / self.spread)
        v = self.factors[at]
        sums = x @ v
        return float(self.bias + x @ self.weights[at] + 0.5 * (sums @ sums - (x * x) @ (v * v).sum(axis=1)))


def _row(at: np.ndarray, values: np.ndarray, standard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate((at, BUCKETS + np.arange(len(standard)))), np.concatenate((values, np.clip(standard, -5, 5)))


def fit(pairs: list, statistics: np.ndarray, labels: np.ndarray, class_weights: dict[int, float], seed: int = 0) -> Model:
    """Trains the machine by Adam on the weighted logistic loss, with decay on all but the bias."""
    if len(set(labels.tolist())) < 2:
        return Model(None, None, 20.0 if len(labels) and labels[0] else -20.0)
    mean, spread = statistics.mean(axis=0), statistics.std(axis=0) + 1e-6
    rows = [_row(a, x, s) for (a, x), s in zip(pairs, (statistics - mean) / spread, strict=True)]
    rng = np.random.default_rng(seed)
    n = BUCKETS + statistics.shape[1]
    weights, factors, bias = np.zeros(n), rng.normal(0, 0.05, (n, RANK)), np.zeros(1)
    importance = np.array([class_weights[int(y)] for y in labels])
    importance /= importance.mean()
    adam = Adam([weights, factors, bias], RATE)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), BATCH):
            batch = order[i : i + BATCH]
            sizes = np.array([len(rows[j][0]) for j in batch])
            begins = np.cumsum(sizes) - sizes
            at = np.concatenate([rows[j][0] for j in batch])
            x = np.concatenate([rows[j][1] for j in batch])
            v = factors[at]
            xv = x[:, None] * v
            sums = np.add.reduceat(xv, begins)
            logits = bias + np.add.reduceat(x * weights[at], begins) + 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((xv**2).sum(axis=1), begins))
            error = (sigmoid(logits) - labels[batch]) * importance[batch] / len(batch)
            each = np.repeat(error, sizes) * x
            to_factors = each[:, None] * (np.repeat(sums, sizes, axis=0) - xv)
            gradient = np.stack([np.bincount(at, to_factors[:, k], n) for k in range(RANK)], axis=1)
            adam.step((np.bincount(at, each, n) + DECAY * weights, gradient + DECAY * factors, np.array([error.sum()])))
    return Model(weights, factors, float(bias[0]), mean, spread)


def train(docs: DataFrame, labels: DataFrame, learnable: Column, per_class: int = 1500, most_bytes: int = 8 << 20) -> Model:
    """The machine learnt from ``labels.quality`` of rows where ``learnable`` (a condition on doc_id)
    holds, from at most ``per_class`` rows of each class and ``most_bytes`` of text.
    """
    texts, found, weights = labelled(docs, labels, "quality", learnable, per_class, most_bytes)
    buckets = _Buckets()
    at, values, statistics = zip(*(features(t, buckets) for t in texts), strict=True) if texts else ((), (), ())
    return fit(list(zip(at, values, strict=True)), np.array(statistics), found.astype(np.float64), weights)


def score_quality(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of ``docs`` but any of that name, and ``name``: double, 0 to 1.

    Nulls and other cases: a null text is scored as an empty one; texts of any length are scored
    whole; rows are scored one by one, so repeated rows and ties score alike; a model without both
    classes in its labels scores all texts alike; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by BUCKETS
    others = [c for c in docs.columns if c.lower() != name.lower()]
    kept = docs.select(*others, F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, buckets = sent.value, _Buckets()
        for part in text_slices(batches, len(others)):
            logits = [model.logit(*features(t, buckets)) for t in utf8(part.column(part.num_columns - 1))]
            yield pa.record_batch([*part.columns[:-1], pa.array(sigmoid(np.array(logits, dtype=np.float64)))], names=[*others, name])

    schema = docs.select(*others).withColumn(name, F.lit(0.0)).schema
    return kept.mapInArrow(run, schema)

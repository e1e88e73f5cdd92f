"""Bounded samples of labelled rows, and the optimizer that classifiers share."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import utf8


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo ``folds``; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled(
    docs: DataFrame, labels: DataFrame, label: str, learnable: Column, per_class: int, most_bytes: int
) -> tuple[list[bytes], np.ndarray, dict[int, float]]:
    """Texts (UTF-8, whole) and classes of labelled rows, and what each of them stands for: the number
    of learnable labels of its class over the sampled ones.

    ``learnable`` is a condition on ``doc_id``.  A class gives at most ``per_class`` rows and half of
    ``most_bytes``: rows come in the order of a hash of doc_id, repeated rows once, and one that would
    exceed the bytes is passed over.  Only ids and sizes are ranked; the driver holds that many bytes.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(learnable & F.col("label").isin(0, 1))
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    order = (F.xxhash64("doc_id"), "doc_id")
    parts = [usable.where(F.col("label") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    row = F.xxhash64("doc_id", "text").alias("row")
    found = docs.select("doc_id", row, "text").join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")
    sized = found.groupBy("doc_id", "row", "label").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size"))
    chosen, weights = [], {}
    for c in (0, 1):
        left, n = most_bytes // 2, 0
        for r in sized.where(F.col("label") == c).orderBy(*order, "row").limit(per_class).collect():
            if r["size"] <= left:
                left, n = left - r["size"], n + 1
                chosen.append((r["row"], c))
        weights[c] = counts.get(c, 0) / max(1, n)
    wanted = docs.sparkSession.createDataFrame(chosen, "_row long, label int")
    texts = docs.select(row, F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(wanted), F.col("row") == F.col("_row"))
    table = texts.groupBy("row", "label").agg(F.first("text").alias("text")).orderBy("row", "label").toArrow()
    return utf8(table.column("text").combine_chunks()), np.array(table.column("label").to_pylist(), dtype=np.int64), weights


class Adam:
    """Adam steps on a list of arrays, in place."""

    def __init__(self, arrays: list[np.ndarray], rate: float):
        self.arrays, self.rate, self.t = arrays, rate, 0
        self.first = [np.zeros_like(a) for a in arrays]
        self.second = [np.zeros_like(a) for a in arrays]

    def step(self, gradients: Iterable[np.ndarray]) -> None:
        self.t += 1
        for a, m, v, g in zip(self.arrays, self.first, self.second, gradients, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))

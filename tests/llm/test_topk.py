import math
import random

from pyspark.sql import functions as F

import notespark.llm.topk as topk
from notespark.llm.topk import top_k


def _plain(rows, k):
    vectors = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        vectors.append((i, [math.floor(1024 * x) for x in v]))
    out = []
    for i, v in sorted({(i, tuple(v)) for i, v in vectors if i % 10 == 0}):
        limit = 2**63 - 1
        scores = [(-max(-limit, min(limit, sum(a * b for a, b in zip(v, w)))), j) for j, w in vectors if j != i]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return out


def _check(spark, rows, k=10):
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    got = sorted(tuple(r) for r in top_k(table, F.col("vec_id") % 10 == 0, k).collect())
    assert got == sorted(_plain(rows, k))


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "LONGEST", 20)
    monkeypatch.setattr(topk, "CHUNK", 16)
    rng = random.Random(4)
    centres = [[rng.gauss(0, 0.4) for _ in range(12)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)]) for i in range(400)]
    rows += [(1000 + i, centres[0]) for i in range(40)]  # ties
    _check(spark, rows)
    monkeypatch.setattr(topk, "BLOCK_BYTES", 8 * 12 * 7)  # several blocks of queries
    _check(spark, rows, 3)


def test_awkward_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [0.1, 0.2]), (1, None), (2, [None, 0.1]), (3, [inf, 0.0]), (4, [nan, 1.0]), (None, [1.0, 1.0]),
            (5, [0.1, 0.2]), (5, [0.1, 0.2]), (10, []), (20, [0.3]), (30, [-0.5, 0.0]), (30, [-0.5, 0.0]), (30, [0.5, 0.0])]
    _check(spark, rows)
    _check(spark, [(0, [1e300, 1.0]), (1, [1e300, -1.0]), (2, [-1e12, 1.0]), (10, [3e9, 5e9])])
    _check(spark, [(0, [1.0]), (1, [2.0])])
    _check(spark, [(0, [1.0])])
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(empty, F.col("vec_id") % 10 == 0).collect() == []

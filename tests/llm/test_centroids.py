import hashlib
import math
import random

import pytest

import notespark.llm.centroids as centroids
from notespark.llm.centroids import cluster_vectors


def _plain(rows, k, rounds, width):
    points = []
    for i, v in rows:
        if v is None or len(v) != width or any(x is None or not math.isfinite(x) or abs(1024 * x) >= 2**62 for x in v):
            continue
        points.append((i, [math.floor(1024 * x) for x in v]))
    order = sorted((i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "", p) for i, p in points)
    centres = [p for _, _, p in order[:k]]
    far = lambda p, c: sum((a - b) ** 2 for a, b in zip(p, c))
    nearest = lambda p: min(range(len(centres)), key=lambda j: (far(p, centres[j]), j))
    for _ in range(rounds):
        of = [nearest(p) for _, p in points]
        for j in range(len(centres)):
            own = [p for (_, p), a in zip(points, of) if a == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own)]
    most = 2**63 - 1
    out = [(i, a := nearest(p), far(p, centres[a])) for i, p in points]
    inertia = lambda j: sum(min(d, most) for _, a, d in out if j is None or a == j)
    digest = lambda j: hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()
    return sorted(((i, a, min(d, most), min(inertia(a), most), min(inertia(None), most), digest(a)) for i, a, d in out), key=str)


def _check(spark, rows, k=8, rounds=10, width=4, **more):
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string").repartition(3)
    got = sorted((tuple(r) for r in cluster_vectors(table, k, rounds, width, **more).collect()), key=str)
    assert got == _plain(rows, k, rounds, width)


@pytest.mark.parametrize("k,listed", [(8, None), (8, 1), (20, 6), (3, 2), (1, None)])
def test_equals_plain_rounds(spark, monkeypatch, k, listed):
    monkeypatch.setattr(centroids, "CHUNK", 64)
    rng = random.Random(k)
    spots = [[rng.gauss(0, 0.5) for _ in range(4)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.15) for x in rng.choice(spots)]) for i in range(500)]
    rows += [(1000 + i, [rng.randrange(-3, 4) / 1024 for _ in range(4)]) for i in range(300)]  # many ties
    _check(spark, rows, k, listed=listed)


def test_most_vectors_keep_their_centroid_unseen(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-40, 40, (200, 8)) + 1000 * j for j in range(10)])
    centres = [points[200 * j].tolist() for j in range(10)]
    first = centroids._Round(centres, [0.0] * 10, 3).assign(points, None)
    moved = [[x + 1 for x in c] for c in centres]
    step = centroids._Round(moved, [math.sqrt(8) * (1 + 1e-12)] * 10, 3)
    monkeypatch.setattr(step, "_prefix", lambda *a: pytest.fail("measured"))
    monkeypatch.setattr(centroids, "_squares", lambda *a: pytest.fail("measured"))
    assert (step.assign(points, first)[0] == first[0]).all()


def test_awkward_rows(spark):
    inf, nan = float("inf"), float("nan")
    same = [0.25, 0.5, -0.1, 0.0]
    rows = [(i, same) for i in range(30)] + [(7, same), (None, [0.1] * 4), (40, None), (41, [None, 1.0, 1.0, 1.0]), (42, [inf, 0.0, 0.0, 0.0]),
            (43, [nan, 0.0, 0.0, 0.0]), (44, []), (45, [1.0] * 5), (46, [1.0] * 3), (47, [-0.0001, 0.0001, 0.0, -0.0])]
    _check(spark, rows)
    _check(spark, rows[:3])
    _check(spark, [])
    _check(spark, [(None, same), (None, [0.5] * 4), (1, same)])
    wide = [(i, [1e9 * (i % 5), 1e9, -1e9, i * 1.0]) for i in range(40)] + [(50, [1e15, 0.0, 0.0, 0.0]), (51, [1e300, 0.0, 0.0, 0.0]), (52, same)]
    _check(spark, wide, k=6)
    _check(spark, wide + [(100 + i, [i / 100, 0.1, 0.2, 0.3]) for i in range(60)], k=4, rounds=5)

import random

import numpy as np
from pyspark.sql import functions as F

from notespark.llm._labels import remainder
from notespark.llm.queries import op9_quality
from notespark.llm.quality import BUCKETS, STATISTICS, Model, _Buckets, features, score_quality, train


def _fixture(spark, n=240):
    rng = random.Random(3)
    words = ["".join(rng.choices("aeioulmnrt", k=rng.randrange(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.randrange(10, 200))
        good = i % 3 > 0
        if not good:
            kind = i % 2
            text = [w.upper() + "!!" for w in text] if kind else [rng.choice(text[:4])] * len(text)
        docs.append((i, " ".join(text)))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_the_identity_equals_all_pairs():
    rng = np.random.default_rng(1)
    n = BUCKETS + len(STATISTICS)
    model = Model(rng.normal(size=n), rng.normal(size=(n, 4)), 0.3, np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    at, x, statistics = features(b"One two two, THREE!! 4 | | \nfive", _Buckets())
    index = [*at.tolist(), *range(BUCKETS, n)]
    value = [*x.tolist(), *np.clip(statistics, -5, 5).tolist()]
    plain = 0.3 + sum(model.weights[i] * v for i, v in zip(index, value))
    for a in range(len(index)):
        for b in range(a):
            plain += model.factors[index[a]] @ model.factors[index[b]] * value[a] * value[b]
    assert abs(model.logit(at, x, statistics) - plain) < 1e-6


def test_held_out_accuracy(spark):
    docs, labels = _fixture(spark)
    learnable = remainder(F.col("doc_id"), 4) != 2
    scored = score_quality(docs, train(docs, labels, learnable))
    got = np.array([(r.doc_id % 3 > 0, r.score >= 0.7) for r in scored.where(~learnable).collect()])
    assert (got[:, 0] == got[:, 1]).mean() >= 0.9


def test_awkward_rows(spark):
    docs, labels = _fixture(spark, 60)
    model = train(docs, labels, F.lit(True))
    rows = [(1, None, 5), (2, "", 5), (None, "\x85 é | |", 5), (3, "calm " * 30000, 5), (3, "calm " * 30000, 5)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, score int")
    scores = [r.score for r in score_quality(odd, model).collect()]
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores) and scores[0] == scores[1] and scores[3] == scores[4]
    assert score_quality(odd.limit(0), model).count() == 0
    none = train(docs.limit(0), labels, F.lit(True))
    assert none.weights is None and all(r.score < 0.5 for r in score_quality(odd, none).collect())


def test_query(spark, sf):
    rows = op9_quality(spark, sf).collect()
    assert len(rows) == 200 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)

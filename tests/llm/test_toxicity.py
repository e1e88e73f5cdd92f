import random
import re

import numpy as np
from pyspark.sql import functions as F

from notespark.llm import toxicity
from notespark.llm._labels import labelled, remainder
from notespark.llm.queries import op8_toxicity
from notespark.llm.toxicity import _EDGES, _ODD, BUCKET_BITS, BUCKETS, GRAMS, PASSAGE, Model, Words, _Bags, passages, score_toxicity, train

M32 = (1 << 32) - 1


def _fixture(spark, n=300):
    rng = random.Random(2)
    calm = ["".join(rng.choices("aeioulmnrt", k=rng.randrange(2, 8))) for _ in range(400)]
    rude = ["grumblewort", "snarkface", "blatherskite"]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(calm, k=rng.randrange(10, 300))
        toxic = i % 4 == 0
        for _ in range(max(1, len(words) // 40) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(rude))
        docs.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def _plain_logit(model, text):
    """The most toxic passage by one word and one n-gram after the other."""
    def words():
        for word in re.findall(r"[^\x20\x09-\x0d]+", text.lower()):
            marked = f"<{word.strip(_EDGES)}>"
            pieces = [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)]
            yield pieces, marked

    def mixed(x):
        x = (x ^ x >> 15) * 0x2C1B3C6D & M32
        return x ^ x >> 12

    def bucket(x):
        return mixed(x * 0x85EBCA6B & M32) >> 32 - BUCKET_BITS

    value = lambda c: mixed(ord(c) * 0x9E3779B1 + 0x7F4A7C15 & M32)
    odd = [int(x) for x in _ODD]
    each = []
    for pieces, marked in words():
        at = [bucket(sum(value(c) * odd[j] for j, c in enumerate(p)) + odd[8 + len(p) - 1] & M32) for p in pieces]
        whole = sum(value(c) * pow(0xD6E8FEB86659FD93, j, 1 << 64) for j, c in enumerate(marked)) % (1 << 64)
        at.append(bucket((whole ^ whole >> 32) & M32))
        each.append(np.mean([model.share[b] for b in at]))
    best = [np.mean(each[s : s + PASSAGE]) for s in passages(len(each)).tolist()] if each else [0.0]
    return model.bias + max(best)


def test_scores_equal_a_plain_scorer(monkeypatch):
    rng = random.Random(5)
    model = Model(np.random.default_rng(1).normal(0, 1, BUCKETS), -0.3)
    parts = ["a", "The", "STRASSE,", "straße", "...", "(x)", "İx", "日本語", "it's", "e\u0301", "\x7f", "longer-word", "n\xa0b", "w" * 70]
    texts = ["", " \t", "one"] + ["".join(rng.choice(parts) + rng.choice([" ", "\n", " \r "]) for _ in range(rng.randrange(300))) for _ in range(40)]
    for piece in (1 << 19, 50):
        monkeypatch.setattr(toxicity, "_PIECE", piece)
        got = model.logits([t.encode() for t in texts])
        assert np.allclose(got, [_plain_logit(model, t) for t in texts])


def test_training_sees_all_passages():
    texts = [b"a bb ccc " * 70, b"", b"x", b"dd " * 64]
    bags = _Bags(texts)
    assert bags.owners.tolist() == [0] * len(passages(210)) + [2, 3]
    seen = {(o, i) for o, b, n in zip(bags.owners, bags.begins, bags.sizes, strict=True) for i in range(b, b + n)}
    assert seen == {(0, i) for i in range(210)} | {(2, 210)} | {(3, i) for i in range(211, 275)}
    assert bags.gram_sizes[bags.tokens[1]] == Words("bb").counts()[0]


def test_the_sample_is_bounded(spark):
    docs, labels = _fixture(spark)
    texts, found, weights = labelled(docs.unionByName(docs), labels, "toxic", F.lit(True), 30, 1 << 20)
    assert sorted(found.tolist()) == [0] * 30 + [1] * 30 and weights == {0: 225 / 30, 1: 75 / 30}
    texts, found, _ = labelled(docs, labels, "toxic", F.lit(True), 300, 4000)
    assert 0 < len(texts) < 60 and sum(map(len, texts)) <= 4000 and set(found.tolist()) == {0, 1}


def test_passages_cover_whole_texts():
    for n in (0, 1, PASSAGE, PASSAGE + 1, 5 * PASSAGE + 7):
        covered = {i for s in passages(n).tolist() for i in range(s, min(n, s + PASSAGE))}
        assert covered == set(range(n))


def test_learns_and_catches_unseen_misspellings(spark):
    docs, labels = _fixture(spark)
    learnable = remainder(F.col("doc_id"), 5) != 0
    model = train(docs, labels, learnable)
    scored = score_toxicity(docs, model)
    assert scored.columns == ["doc_id", "text", "score"]
    got = np.array([(r.doc_id % 4 == 0, r.score >= 0.5) for r in scored.where(~learnable).collect()])
    assert (got[:, 0] == got[:, 1]).mean() >= 0.95
    assert model.word("grumbelwort") > 10 * abs(model.word("lunar")) / 4 > 0
    again = score_toxicity(docs, train(docs, labels, learnable)).agg(F.sum("score")).first()[0]
    assert abs(again - scored.agg(F.sum("score")).first()[0]) < 1e-6


def test_awkward_rows(spark):
    docs, labels = _fixture(spark, 60)
    model = train(docs, labels, F.lit(True))
    rows = [(1, None), (2, ""), (None, "snarkface"), (3, "calm " * 30000), (3, "calm " * 30000)]
    odd = spark.createDataFrame(rows, "doc_id long, text string")
    scores = [r.score for r in score_toxicity(odd, model).collect()]
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores) and scores[0] == scores[1] and scores[3] == scores[4]
    assert score_toxicity(odd.limit(0), model).count() == 0
    none = train(docs, labels.limit(0), F.lit(True))
    assert none.share is None and all(r.score < 0.5 for r in score_toxicity(odd, none).collect())
    assert Model(None, 20.0).share is None


def test_query(spark, sf):
    rows = op8_toxicity(spark, sf).collect()
    assert len(rows) == 200 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)

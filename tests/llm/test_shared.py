import random

import notespark.llm._shared as shared
from notespark.llm._shared import n_words, word_hashes
from pyspark.sql import functions as F


def _texts(rng, n):
    parts = ["a", "b", "ab", "é", " ", " ", "\n", "\t\x0b", "\x0c\r", "\x85", "\x1f"]
    return ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(n)] + ["", " ", "x"]


def test_word_hashes_name_words(monkeypatch):
    rng = random.Random(1)
    names = {}
    for piece in (7, 1 << 20):
        monkeypatch.setattr(shared, "_PIECE", piece)
        for _ in range(50):
            texts = [t.encode() for t in _texts(rng, 8)]
            hashes, begins = word_hashes(texts)
            words = [w for t in texts for w in t.split()]
            assert len(hashes) == len(words)
            assert begins.tolist() == [sum(len(t.split()) for t in texts[:i]) for i in range(len(texts))]
            for w, h in zip(words, hashes.tolist()):
                assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)
    assert word_hashes([])[0].size == 0


def test_n_words(spark):
    texts = [None, *_texts(random.Random(2), 200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", n_words(F.col("t")).alias("n")).collect()
    assert all(r.n == len((r.t or "").encode().split()) for r in rows)


def test_long_words_that_a_polynomial_confuses():
    from thue_morse import pair

    a, b = (w.encode() for w in pair())
    hashes, _ = word_hashes([a, b, b"seven77", b"seven77\x00", b"\x00", b"\x00\x00"])
    assert len(set(hashes.tolist())) == 6

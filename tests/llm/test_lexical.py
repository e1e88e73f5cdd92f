import math
import random
import re

import numpy as np
import pytest

import notespark.llm.lexical as lexical
from notespark.llm._shared import written
from notespark.llm.lexical import TERM, build_index, ranked_search, search


def _terms(text):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _plain(docs, items, k):
    docs = [(i, _terms(t)) for i, t in docs]
    docs = [(i, t) for i, t in docs if t]
    n, total = len(docs), sum(len(t) for _, t in docs)
    out = []
    for item, text in items:
        words, found = set(_terms(text)), []
        weights = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(w in t for _, t in docs) + 1))) for w in words}
        for i, t in docs:
            m = 50 + (50 * len(t) * n) // total
            score = sum(weights[w] * ((1000000000 * t.count(w)) // (1000 * t.count(w) + 20 * m)) for w in words)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def _tables(spark, docs, items):
    docs = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, shard string").repartition(3)
    return docs, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")


def _check(spark, docs, items, k=50):
    got = sorted((tuple(r) for r in ranked_search(*_tables(spark, docs, items), k).collect()), key=str)
    assert got == _plain(docs, items, k)


def _corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    text = lambda most: " ".join(rng.choices(words, weights, k=rng.randint(1, most)))
    return [(i, text(60)) for i in rng.sample(range(5 * n), n)], [(j, text(30)) for j in range(12)]


@pytest.mark.parametrize("k", [1, 7, 50])
def test_equals_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(lexical, "BLOCK", 4)
    monkeypatch.setattr(lexical, "SHARD_BYTES", 4000)
    docs, items = _corpus(600, k)
    docs += [(9000 + i, docs[0][1]) for i in range(80)]  # ties
    _check(spark, docs, items + [(99, docs[0][1])], k)


def test_several_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(lexical, "QUERY_BYTES", 100)
    docs, items = _corpus(100, 3)
    _check(spark, docs, items)


def test_blocks_below_the_threshold_stay_compressed(monkeypatch):
    opened = []
    monkeypatch.setattr(lexical, "_numbers", lambda data, plain=lexical._numbers: opened.append(data) or plain(data))
    monkeypatch.setattr(lexical, "BLOCK", 8)
    shard = lexical._Shard()
    for i in range(4000):
        shard.add(i, b"common rare " * 3 if i == 17 else b"common filler" + b" filler" * (i % 50 + 3))
    rows = [r for b in shard.rows(0, 4000, 100_000) for r in b.to_pylist()]
    best = {}
    lexical._search_shard(rows, [(0, ["common", "rare"])], {"common": 10, "rare": 5000, "filler": 1}, best, {}, 1)
    assert best[0][0][1] == -17
    assert len(opened) < 10 < 500 == sum(len(r["blocks"]) for r in rows if r["term"] == "common")


def test_numbers_come_back():
    values = np.array([0, 1, 127, 128, 300, 16383, 16384, 2**31, 2**40, 5])
    coded, begins = lexical._varints(values)
    assert (lexical._numbers(coded.tobytes()) == values).all() and begins[-1] == len(coded)


def test_awkward_rows(spark):
    docs = [(1, None), (2, ""), (3, " .,;"), (4, "Straße ÄB äb k\x00x"), (4, "Straße ÄB äb k\x00x"), (None, "straße"), (None, "straße 7"),
            (5, "word " * 200_000 + "needle"), (6, "needle NEEDLE"), (-7, "x" * 100_000), (8, "\U0001f600K k")]
    items = [(0, "NEEDLE needle word"), (1, None), (2, "?!"), (None, "straße"), (3, "absent"), (4, "k äb ÄB"), (4, "k äb ÄB"), (5, "x" * 100_000), (6, "K")]
    _check(spark, docs, items)
    _check(spark, docs, [])
    _check(spark, [], items)
    _check(spark, [(1, None)], items)


def test_a_written_index_reads_only_the_terms_of_a_search(spark):
    docs, items = _corpus(50, 1)
    docs, items = _tables(spark, docs, items)
    index = written(build_index(docs))
    assert search(index, items.where("item_id < 3"), 5).count() > 0
    assert index.where("term = ''").agg({"n_docs": "sum"}).first()[0] == 50

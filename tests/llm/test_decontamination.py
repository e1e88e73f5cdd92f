import random
from collections import Counter

import notespark.llm.decontamination as d
from notespark.llm.decontamination import RADIUS, _Size, find_leaks, simhash, without_leaks


def _shingles(words, k):
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def _plain(docs, items, similarity):
    out = {}
    for row, (doc, text) in enumerate(docs):
        words = (text or "").encode().lower().split()
        for item, wanted in items:
            other = (wanted or "").encode().lower().split()
            if not words or not other:
                continue
            n, k = min(len(other), len(words)), min(5, len(other))
            for start in range(len(words) - n + 1):
                a, b = _shingles(words[start : start + n], k), _shingles(other, k)
                if not a:
                    continue
                shared = sum((a & b).values())
                value = shared / (sum(a.values()) + sum(b.values()) - shared)
                if value >= similarity and value > out.get((row, doc, item), (0,))[0]:
                    out[(row, doc, item)] = (value, start, n)
    return sorted(((k[1], k[2], round(v[0], 9), *v[1:]) for k, v in out.items()), key=str)


def _check(spark, docs, items, similarity=0.8):
    frame = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    got = [(r.doc_id, r.item_id, round(r.similarity, 9), r.start, r.n_words) for r in find_leaks(frame, bench, similarity).collect()]
    assert sorted(got, key=str) == _plain(docs, items, similarity)
    return frame, bench


def _fixture(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 6, 12, 30, 60])))) for i in range(25)]
    docs = []
    for doc in range(60):
        words = rng.choices(vocabulary, k=rng.randrange(0, 80))
        for _ in range(rng.randrange(3)):
            piece = rng.choice(items)[1].split()
            for _ in range(rng.randrange(3)):
                piece[rng.randrange(len(piece))] = rng.choice(["new", "w3"])
            if rng.random() < 0.3:
                piece = piece[1:]
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() if rng.random() < 0.2 else w for w in piece]
        docs.append((doc, rng.choice([" ", "\n"]).join(words)))
    return docs, items


def test_equals_brute_force(spark, monkeypatch):
    docs, items = _fixture(1)
    frame, bench = _check(spark, docs, items)
    kept = {r.doc_id for r in without_leaks(frame, bench).collect()}
    assert kept == {i for i, _ in docs} - {r[0] for r in _plain(docs, items, 0.8)} != set()
    monkeypatch.setattr(d, "BLOCK_CHARS", 700)  # several blocks of items
    _check(spark, docs, items)


def test_multi_index_finds_all_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(3)
    few, many = (_Size(30, list(range(n)), [rng.integers(0, 2**63, 30).astype(np.uint64) for _ in range(n)]) for n in (40, 400))
    assert few.order is None and many.order is not None
    for size, i in ((size, i) for size in (few, many) for i in range(40)):
        for flips in (0, 5, RADIUS):
            bits = np.unpackbits(size.prints[i], bitorder="little")
            bits[rng.choice(64, flips, replace=False)] ^= 1
            print_ = np.packbits(bits, bitorder="little")
            distance = np.bitwise_count(size.prints ^ print_).sum(axis=1)
            assert size.candidates(print_).tolist() == np.flatnonzero(distance <= RADIUS).tolist()
    assert simhash(np.array([3], dtype=np.uint64)).tolist() == [3, 0, 0, 0, 0, 0, 0, 0]


def test_awkward_rows(spark):
    items = [(1, None), (2, ""), (3, "One"), (None, "a b c d e f"), (5, "x " * 40), (5, "y " * 40)]
    docs = [(1, None), (2, " "), (None, "z a B c d e f z"), (4, "one"), (5, "x " * 3000), (6, "y " * 40), (6, "y " * 40)]
    frame, bench = _check(spark, docs, items)
    assert find_leaks(frame.limit(0), bench).count() == find_leaks(frame, bench.limit(0)).count() == 0
    assert {r.doc_id for r in without_leaks(frame, bench).collect()} == {1, 2}


def test_the_radius_loses_no_leak_of_the_documents(spark, sf, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    found = lambda: {(r.doc_id, r.item_id) for r in find_leaks(docs, bench).collect()}
    got = found()
    monkeypatch.setattr(d, "RADIUS", 64)
    assert got == found() != set()


def test_items_take_little_room():
    import pickle

    rng = random.Random(6)
    items = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(50 + i)).encode()) for i in range(400)]
    assert len(pickle.dumps(d.Items(items, 0.8))) < 5 * sum(len(t) for _, t in items)


def test_long_words_that_a_polynomial_confuses(spark):
    from thue_morse import pair

    texts = [" ".join([*(f"w{i}" for i in range(6)), long, *(f"v{i}" for i in range(6))]) for long in pair()]
    _check(spark, list(enumerate(texts)), [(0, texts[0])])

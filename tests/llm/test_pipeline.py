import random

import corpus_pipeline as p
from notespark.llm import nearcopies
from notespark.llm.nearcopies import near_copies, one_of_each
from notespark.llm.simhash import fingerprint


def _near(rng, words, edits):
    words = [*words]
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return words


def _similarity(a, b):
    x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_copies_are_found_and_others_left(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(10**5)}" for _ in range(rng.randrange(60, 400))]
        texts.append(base)
        for _ in range(rng.randrange(3)):
            texts.append(_near(rng, base, max(1, len(base) // 100)))
    texts += [texts[0], texts[1], [], []]
    rows = [(i, " ".join(t), "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_copies(docs).collect()}
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            if a == b or (len(a) > 20 and len(b) > 20 and _similarity(a, b) >= 0.85):
                assert got[i] == got[j]
            elif a and b and not set(a) & set(b):
                assert got[i] != got[j]
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))
    assert one_of_each(docs.limit(0)).count() == 0
    assert one_of_each(docs.unionByName(docs)).count() == len(set(got.values()))


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == docs.columns and 0.5 * before < out.count() <= before
        if name == "secret scans":
            assert out.where("text LIKE '%token = \"%'").count() == 0
        docs = out
    mixed = p.run(spark, sf).collect()
    assert {r.doc_id for r in mixed} == {r.doc_id for r in docs.collect()}
    assert all(0 <= r.taken <= 3 * r.size for r in mixed)


def _shared(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def _brute(texts, least=0.8):
    """The smallest text that similar pairs reach, for each of the texts."""
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= least * len(a | sets[j]):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(texts))]


def _components(spark, texts):
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies(docs.repartition(3)).collect()}
    return [got[i] for i in range(len(texts))]


def test_families_of_a_template_are_compared_in_full(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "BLOCK", 7)
    rng = random.Random(3)
    template, texts = _shared(rng, 300), []
    for _ in range(120):  # unlike each other at about 0.6 to 0.7
        own = template + _shared(rng, rng.randrange(50, 80))
        texts += [own, _near(rng, own, 2)]
    rng.shuffle(texts)
    want = _brute(texts)
    assert 100 <= len(set(want)) <= 120
    assert _components(spark, texts) == want


def test_chains_past_a_leader_are_followed(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(60):  # C-A and A-B are similar, C-B is not
        base = _shared(rng, 400)
        texts += [base, base[20:] + _shared(rng, 20), base[50:] + _shared(rng, 50), base[80:] + _shared(rng, 80)]
    assert _components(spark, texts) == _brute(texts)


def test_pairs_about_the_threshold_are_exact(spark):
    rng = random.Random(5)
    texts = []
    for i in range(400):
        base = _shared(rng, 300)
        cut = 20 + i % 40
        texts += [base, base[cut:] + _shared(rng, cut)]
    want = _brute(texts)
    assert 400 < len(set(want)) < 800
    assert _components(spark, texts) == want


def test_repeated_shingles_make_no_copies(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(20):
        own = _shared(rng, 100)
        texts += [["ha"] * 200 + own, ["ha"] * 210 + own, ["ha"] * 200 + own[:-1]]
    assert _components(spark, texts) == [i // 3 * 3 for i in range(60)]


def _odd(spark):
    words = " ".join(_shared(random.Random(9), 60))
    others = [" ".join(_shared(random.Random(i), 60)) for i in range(4)]
    rows = [
        (1, words, "en", "a", 5, "own"), (2, words, "en", "b", 5, "own"), (2, others[0], "en", "b", 5, None), (None, others[1], None, None, None, None),
        (None, others[2], "de", "a", 1, "x"), (None, words, "de", "a", 1, "x"), (7, None, "en", "a", 0, "x"), (8, "", "en", "a", 0, "x"), (9, " \t", None, "a", 0, "x"),
        (10, others[3], "en", "a", 5, "one"), (10, others[3], "en", "c", 5, "two"), (11, others[3] + " end", "en", "c", 5, "two"),
    ]
    columns = "doc_id long, text string, lang string, source string, n_chars long, _own string"
    return spark.createDataFrame(rows, columns).repartition(3), words, others


def test_rows_without_ids_or_with_equal_ones_stay_unless_they_are_copies(spark):
    docs, words, others = _odd(spark)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert got == sorted([(1, words), (2, others[0]), (None, others[1]), (None, others[2]), (7, None), (10, others[3])], key=repr)
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, one_of_each(docs.repartition(5)).collect()))
    assert one_of_each(docs.where("doc_id IS NULL")).count() == 3


def test_stages_take_awkward_rows(spark, sf):
    docs, _, _ = _odd(spark)
    clashing = docs.withColumn("score", docs.n_chars).withColumn("_score", docs.lang).withColumn("_leaked", docs.lang)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, clashing, sf)
        rows = out.collect()
        assert out.columns == clashing.columns and len(rows) == (6 if name == "near-dedup" else 12), name
        assert {(r.score, r._score) for r in rows} <= {(r.n_chars, r.lang) for r in docs.collect()} or name == "secret scans"
        assert stage(spark, clashing.limit(0), sf).count() == 0
    name, mix = p.STAGES[-1]
    assert mix(spark, clashing, sf).count() == 12 and mix(spark, clashing.limit(0), sf).count() == 0


def test_long_words_that_a_polynomial_confuses(spark):
    from thue_morse import pair

    texts = [" ".join([*(f"w{i}" for i in range(6)), long, *(f"v{i}" for i in range(6))]) for long in pair()]
    docs = spark.createDataFrame([*enumerate(texts), (2, texts[0])], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_copies(docs).collect()) == [(0, 0), (1, 1), (2, 0)]


def test_simhash_proposes_what_the_bands_miss(spark):
    block = "w885440 w403958 w794772 w933488 w441001 w42450 w271493 w536110 w509532 w424604 w962838 w821872 w870163 w318046 w499748 w375441".split()
    texts = [block * 40 + tail.split() for tail in ("t823182 t700609", "t979112 t50600", "a b c d e f g h i", "j k l m n o p q r")]
    prints = [fingerprint(" ".join(t).encode(), 3) for t in texts]
    sketches = [nearcopies.sketch(next(nearcopies._shingle_sets([" ".join(t).encode()], 5))) for t in texts[:2]]
    bands = [s.reshape(nearcopies.BANDS, -1) for s in sketches]
    assert not (bands[0] == bands[1]).all(axis=1).any()  # a similarity of 0.8, and no band in common
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in zip(prints[:1], prints[1:2]))
    assert _components(spark, texts) == _brute(texts) == [0, 0, 2, 3]  # the sets decide on what fingerprints link

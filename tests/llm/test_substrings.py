import random

import pytest

from notespark.llm.substrings import levels, remove_repeated_passages


def _plain(rows, length):
    """rows: (doc_id, text), in order of doc_id."""
    seen = {}
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - length + 1):
            window = tuple(words[i : i + length])
            if window in seen:
                gone.update(range(i, i + length))
            else:
                seen[window] = (doc, i)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), kept.decode()))
    return out


def _check(spark, rows, length, shuffled=True):
    given = [*rows]
    if shuffled:
        random.Random(3).shuffle(given)
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in remove_repeated_passages(docs, length).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r)
    assert sorted(got, key=key) == _plain(rows, length)


def test_levels():
    assert levels(20) == [5, 10, 20]
    assert levels(50) == [25, 50]
    assert levels(16) == [4, 8, 16]
    assert levels(7) == [7]


@pytest.mark.parametrize("length", [20, 8, 7])
def test_equals_plain_removal(spark, length):
    rng = random.Random(length)
    passages = [[rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.randrange(4, 70))] for _ in range(12)]
    rows = []
    for doc in range(90):
        words = []
        for _ in range(rng.randrange(0, 5)):
            passage = [*rng.choice(passages)]
            if rng.random() < 0.5 and len(passage) > 6:
                passage[rng.randrange(len(passage))] = "x" + str(rng.randrange(4))
            cut = rng.randrange(0, 10)
            words += passage[cut:] + [str(rng.randrange(1000)) for _ in range(rng.randrange(0, 4))]
        rows.append((doc, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(200, "z " * 300), (201, "z " * 25), (202, "p q " * 60), (203, "q p " * 30)]
    _check(spark, rows, length)


def test_awkward_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, " \n"), (4, text), (5, text), (6, "short text"), (7, "É é\x85 " * 30), (None, text)]
    _check(spark, rows, 20)
    same = spark.createDataFrame([(1, text, "a"), (1, text, "b"), (1, "w " * 40, "c"), (2, text, "d")], "doc_id long, text string, kept string")
    got = sorted(tuple(r) for r in remove_repeated_passages(same).select("doc_id", "n_words", "n_removed").collect())
    assert got == [(1, 30, 0), (1, 30, 0), (1, 40, 39), (2, 30, 30)] or got == [(1, 30, 0), (1, 30, 0), (1, 40, 40), (2, 30, 30)]
    assert remove_repeated_passages(same.limit(0)).count() == 0


def test_long_words_that_a_polynomial_confuses(spark):
    from thue_morse import pair

    words = [f"w{i}" for i in range(25)]
    rows = [(i, " ".join([*words[:13], long, *words[13:]])) for i, long in enumerate(pair())]
    _check(spark, rows, 20)
    assert [r.n_removed for r in remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), 20).collect()] == [0, 0]
    _check(spark, [*rows, (2, rows[0][1])], 20)

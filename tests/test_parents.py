import random

from notespark.operators.distribute import parents_by_title


def _parent(rows, draft, title):
    """By the definition, all with all."""
    words = lambda t: {w for w in t.lower().split() if w}
    own, size, found = words(title), len(title.encode()), []
    for d, i, t in rows:
        if d == draft and t is not None and len(t.encode()) < size:
            other = words(t)
            alike = any(len(o.encode()) >= 4 and (o.startswith(w) or w.startswith(o)) for o in other for w in own)
            if other <= own or alike:
                found.append(i)
    return min(found, default=None)


def test_equals_all_pairs(spark):
    rng = random.Random(4)
    words = ["a", "ab", "abc", "äb", "tin", "steel", "ste", "Steel", "steels", "x", "brass", "bras", "éclair"]
    rows = [(rng.choice([1, 2, 3]), i, rng.choice([" ", "  "]).join(rng.choices(words, k=rng.randrange(0, 4)))) for i in range(250)]
    rows += [(None, 300, "tin"), (None, 301, "tin steel"), (1, 302, None), (2, 303, "   ")]
    chunks = spark.createDataFrame(rows, "draft_id long, chunk_index long, title string")
    got = {r.chunk_index: r.parent_index for r in parents_by_title(chunks).collect()}
    assert got == {i: None if t is None or d is None else _parent(rows, d, t) for d, i, t in rows}


def test_equal_titles_meet_as_one(spark):
    """Pairs of these would be over a hundred million, and once brought the driver down."""
    rows = spark.range(24_000).selectExpr("id % 2 draft_id", "id chunk_index", "concat('steel brass', if(id % 3 = 0, ' tin', '')) title")
    found = parents_by_title(rows).groupBy("parent_index").count().collect()
    assert {r.parent_index: r["count"] for r in found} == {None: 16_000, 1: 4_000, 2: 4_000}

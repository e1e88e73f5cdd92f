import itertools
import random

from pyspark.sql import functions as F

from notespark.operators.keyword import snippet
from notespark.operators.titles import ADJACENT, GAP, GAP_MORE, HEAD, MATCH, WORD_START, alignment, fuzzy_search


def _plain(query, title):
    """The best of all ways to place the query's characters."""
    q, t = query.lower(), title.lower()
    best = None
    for at in itertools.combinations(range(len(t)), len(q)):
        if not q or any(t[i] != c for i, c in zip(at, q)):
            continue
        score = 0
        for n, i in enumerate(at):
            bonus = HEAD if i == 0 else WORD_START if t[i].isalnum() and not t[i - 1].isalnum() else 0
            score += MATCH + (2 * bonus if n == 0 else bonus)
            if n:
                gap = i - at[n - 1] - 1
                score += ADJACENT if not gap else GAP + GAP_MORE * (gap - 1)
        best = score if best is None else max(best, score)
    return best


def test_alignment_is_the_best_of_all(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choices("aAb c", k=rng.randrange(0, 5))), "".join(rng.choices("abB c-", k=rng.randrange(0, 12)))) for _ in range(200)]
    rows += [("mth", "Math"), ("xyz", "Math"), ("", "Math"), ("äß", "Ä straße")]
    got = spark.createDataFrame(rows, "q string, t string").select("q", "t", alignment(F.col("q"), F.col("t")).alias("s")).collect()
    for r in got:
        assert r.s == _plain(r.q, r.t), (r.q, r.t)


def test_fuzzy_search_ranks_titles(spark):
    titles = [(1, "Math"), (2, "my aunt thinks highly"), (3, "Mathematics"), (4, "Math"), (5, None), (6, ""), (7, "History / Math")]
    asked = [(0, "math"), (1, "math"), (2, ""), (3, None), (4, "zz"), (5, "hm")]
    table = spark.createDataFrame(titles, "note_id long, title string")
    found = fuzzy_search(table, spark.createDataFrame(asked, "query_id long, query string"), 3).collect()
    want = []
    for i, q in asked:
        held = [(-_plain(q, t), t, n) for n, t in titles if q and t and _plain(q, t) is not None]
        want += [(i, n, t, -s, r) for r, (s, t, n) in enumerate(sorted(held)[:3])]
    assert sorted(tuple(r) for r in found) == sorted(want)
    assert {r.query_id for r in found} == {0, 1, 5}


def test_snippets_show_the_window_with_most_words(spark):
    filler = "x" * 60
    texts = [f"heat {filler} heat and thing {filler}", "Heat", f"{filler} nothing", filler, f"heat heat {filler} THING heat", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(snippet(F.col("t"), "heat thing")).collect()]
    assert got[0].startswith("…") and got[0].endswith("…") and "<b>heat</b> and <b>thing</b>" in got[0]
    assert got[1] == "<b>Heat</b>"
    assert "no<b>thing</b>" in got[2]
    assert got[3] == "x" * 34 + "…"
    assert got[4].endswith("<b>THING</b> <b>heat</b>") and got[4].startswith("…")
    assert got[5] is None

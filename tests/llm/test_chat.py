import random

from pyspark.sql import functions as F

from notespark.llm.chat import escaped, format_conversations, read_back, unescaped


def test_escapes_are_reversible(spark):
    rng = random.Random(1)
    parts = ["\\", "b", "h", "e", "c", "### ", "#", " ", "</turn>", "</turn", ">", "\n", ":", "é", "### role: x</turn>\n"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(400)] + ["", "\\### Assistant: </turn> ok"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    back = rows.select("t", unescaped(escaped(F.col("t"))).alias("x"), escaped(F.col("t")).alias("e"),
                       unescaped(escaped(F.col("t"), True), True).alias("r")).collect()
    for r in back:
        assert r.t == r.x == r.r
        assert "### " not in r.e and "</turn>" not in r.e


def _ordered(rows):
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    return [(r[2] or "", r[3] or "") for r in sorted(rows, key=key)]


def test_windows_round_trip_and_respect_the_budget(spark):
    rng = random.Random(2)
    rows = []
    for conv in range(12):
        for turn in range(rng.choice([1, 2, 9, 60])):
            role = "system" if turn == 0 and conv % 2 else rng.choice(["user", "assistant", "system", "a: b"])
            rows.append((conv, turn, role, "".join(rng.choices("ab### </turn>\\:\né ", k=rng.randrange(60)))))
    rows += [(50, None, None, None), (50, 1, "user", "x"), (50, 1, "user", "x"), (None, 0, "user", "q"), (51, 0, "system", "s")]
    turns = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, window string")
    windows = format_conversations(turns, budget=120, history=30, system=20).cache()
    got = {r.conv_id: r for r in read_back(windows).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert set(got) == set(by)
    longest = 18
    for conv, own in by.items():
        want = _ordered(own)
        assert [tuple(t) for t in got[conv].turns] == want
        assert got[conv].loss == "".join(t for r, t in want if r == "assistant")
    some = windows.orderBy("conv_id", "window").collect()
    assert all(r.n_tokens <= 120 + longest for r in some)
    assert sum(len(r.text) for r in some if r.conv_id == 51) == got[51].formatted_chars
    later = [r for r in some if r.window > 0]
    assert later and any(r.n_context for r in later)
    for r in later:  # a conversation that opens with its system turn shows it again in every window
        first = _ordered(by[r.conv_id])[0]
        if first[0] == "system":
            assert r.text.startswith("### system: ")
    assert windows.where("window > 0").groupBy("conv_id").count().count() > 2
    assert format_conversations(turns.limit(0)).count() == 0

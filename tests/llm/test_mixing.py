import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from notespark.llm import mixing
from notespark.llm.mixing import mix_sources
from notespark.llm.queries import op2_mix_sources

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _targets(sizes, weights, epochs=3):
    """Shares by weight, those above ``epochs`` times their size cut, until none is above."""
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(epochs * sizes[s] for s in capped)
        free = sum(weights[s] for s in sizes if s not in capped)
        share = {s: epochs * sizes[s] if s in capped else left * weights[s] / free for s in sizes}
        over = {s for s in sizes if s not in capped and share[s] > epochs * sizes[s]}
        if not over:
            return share
        capped |= over


def _plain(rows):
    """The mix by a walk over each source's rows in the order of their keys."""
    def key(r):
        name = "null" if r[0] is None else str(r[0])
        return hashlib.md5(f"{name}:{hashlib.md5((r[1] or '').encode()).hexdigest()}:mix".encode()).hexdigest()

    by_source = defaultdict(list)
    for r in rows:
        by_source[r[2]].append(r)
    names = sorted((s for s in by_source if s is not None), key=lambda s: s.encode()) + [s for s in by_source if s is None]
    size = lambda r: len(WORD.findall(r[1] or ""))
    sizes = {s: sum(map(size, by_source[s])) for s in names}
    targets = _targets(sizes, {s: i % 3 + 1 for i, s in enumerate(names)})
    out = []
    for s in names:
        budget = round(targets[s])
        whole = budget // sizes[s] if sizes[s] else 0
        left = budget - whole * sizes[s]
        for r in sorted(by_source[s], key=key):
            part = min(left, size(r))
            left -= part
            out.append((r[0], s, size(r), sizes[s], whole * size(r) + part))
    return sorted(out, key=repr), targets


def _rows(seed, n=400):
    rng = random.Random(seed)
    sources = ["http://a", "http://b", "httq", "é", "z", "Z", "", None, "ww", "www"]
    rows = []
    for _ in range(n):
        text = rng.choice([None, "", " \t ", " ".join(rng.choices(["a", "bb", "c\xa0d", "é"], k=rng.randrange(60)))])
        rows.append((rng.choice([None, None, rng.randrange(50)]), text, rng.choice(sources[: rng.randrange(1, 11)]), "x"))
    return rows + rows[:100] + [rows[0]] * 30


@pytest.mark.parametrize("chunk", [4096, 7])
def test_equals_a_plain_mix(spark, monkeypatch, chunk):
    monkeypatch.setattr(mixing, "_CHUNK", chunk)
    rows = _rows(chunk)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string").repartition(5)
    got = mix_sources(docs).collect()
    want, targets = _plain(rows)
    assert sorted(((r.doc_id, r.source, r.size, r.source_size, r.taken) for r in got), key=repr) == want
    assert all(abs(r.target - targets[r.source]) < 1e-6 * max(1, r.target) and r.taken <= 3 * r.size for r in got)
    again = mix_sources(docs.repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_empty_tables_and_texts(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.size, r.taken, r.target) for r in mix_sources(docs).collect()) == [(1, 0, 0, 0.0), (2, 0, 0, 0.0)]
    assert mix_sources(docs.limit(0)).count() == 0


def test_rows_without_ids_are_spread(spark):
    docs = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    rows = mix_sources(docs)
    assert rows.count() == 2000 and rows.agg(F.sum("taken")).first()[0] == 4000
    key = F.md5(F.concat(F.lit("null:"), F.md5("text"), F.lit(":mix")))
    assert docs.select(F.substring(key, 1, 2)).distinct().count() > 200


def test_query(spark, sf):
    rows = op2_mix_sources(spark, sf).collect()
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want, _ = _plain(docs)
    assert sorted((r.doc_id, r.size, r.source_size, r.taken) for r in rows) == sorted((d, n, m, t) for d, _, n, m, t in want)

import json
import random

from pyspark.sql import functions as F

from notespark.functions import prompts
from notespark.functions import text as tx
from notespark.operators import distribute, fragments, hierarchy, review, store, tags
from notespark.schemas import SCHEMAS


def _nodes(spark, rows):
    return spark.createDataFrame(rows, "id long, parent_id long, name string").repartition(4)


def test_a_long_chain_and_a_cycle(spark):
    n = 5000  # thirteen rounds
    chain = [(i, i - 1 if i else None, "x") for i in range(n)]
    cycle = [(n + i, n + (i + 1) % 7, "c") for i in range(7)] + [(n + 50, n + 3, "below a cycle"), (n + 60, n + 60, "its own parent"), (n + 70, 10**9, "orphan")]
    order = [*chain, *cycle]
    random.Random(1).shuffle(order)
    nodes = _nodes(spark, order)
    assert {r.id: r.depth for r in hierarchy.depths(nodes).collect()} == {i: i for i in range(n)}
    assert sorted(r.id for r in hierarchy.below(nodes, "id", "parent_id", 4000).collect()) == list(range(4000, n))
    assert sorted(r.id for r in hierarchy.below(nodes, "id", "parent_id", n + 2).collect()) == [*range(n, n + 7), n + 50]
    plan = nodes.select(F.col("id").alias("chunk_index"), F.col("parent_id").alias("parent_index"))
    levels = {r.chunk_index: r.level for r in distribute.creation_levels(plan).collect()}
    assert levels == {i: i if i < n else 0 for i, _, _ in order}


def test_paths_of_deep_trees(spark):
    n = 300
    rows = [(i, i - 1 if i else None, f"n{i}") for i in range(n)] + [(n + i, n + (i + 1) % 5, "c") for i in range(5)] + [(800, n + 2, "d"), (801, 999, "o"), (802, 801, "p")]
    found = {r.id: r for r in hierarchy.tree_paths(_nodes(spark, rows)).collect()}
    assert set(found) == set(range(n))
    last = found[n - 1]
    assert last.depth == n - 1 and last.ancestors == list(range(n)) and last.path == "/".join(f"n{i}" for i in range(n))
    found = {r.id: r for r in hierarchy.tree_paths(_nodes(spark, rows), orphans=True).collect()}
    assert set(found) == {*range(n), 801, 802} and found[802].path == "o/p" and found[802].depth == 1 and found[802].parent_id == 801
    assert hierarchy.tree_paths(_nodes(spark, [])).collect() == []


def test_random_forests(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, *range(i)]) if i else None, f"n{i}") for i in range(200)]
    parent = {i: p for i, p, _ in rows}

    def way(i):
        return [] if i is None else [*way(parent[i]), i]

    found = hierarchy.tree_paths(_nodes(spark, rows)).collect()
    assert {r.id: r.ancestors for r in found} == {i: way(i) for i in parent}
    pairs = {(r.ancestor_id, r.descendant_id, r.depth) for r in hierarchy.closure(spark.createDataFrame(found)).collect()}
    assert pairs == {(a, i, len(way(i)) - 1 - d) for i in parent for d, a in enumerate(way(i))}


def test_renaming_and_deleting_reach_all_levels(spark):
    n = 130
    rows = [(i, i - 1 if i else None, f"t{i}", f"t{i}", i, "/".join(f"t{j}" for j in range(i + 1))) for i in range(n)]
    table = spark.createDataFrame(rows, "tag_id long, parent_tag_id long, name string, slug string, depth int, path_cached string")
    after = {r.tag_id: r.path_cached for r in tags.renamed(table, 3, "New").collect()}
    assert after[n - 1].startswith("t0/t1/t2/new/t4/") and after[2] == "t0/t1/t2"
    links = spark.createDataFrame([(i, i) for i in range(n)], "note_id long, tag_id long")
    left, note_tags, _ = tags.deleted(table, links, links.withColumnRenamed("note_id", "fragment_id"), 5)
    assert left.count() == 5 and note_tags.count() == 5
    try:
        store.paths_rewritten(table, "tag_id", "parent_tag_id", 3, new_parent=120, moved=True, title="slug")
        raise AssertionError("moved below itself")
    except ValueError:
        pass


def test_tokens_between_any_white_space(spark):
    texts = ["one　two　three　four　five six", "", " ", "a b c\x85d", "x" * 30]
    want = [9, 0, 1, 6, 10]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.n_tokens(F.col("t"))).collect()]
    assert got == want


def test_packing_many_lines(spark):
    lines = [f"line {i} " + "word " * (i % 13) for i in range(3000)] + ["long " * 400]
    packed = fragments.by_bytes(spark.createDataFrame([(1, "\n".join(lines)), (2, ""), (3, None)], "doc_id long, text string"), 500)
    got = [(r.n_pieces, r["size"], r.text) for r in packed.orderBy("doc_id", "fragment").collect()]
    want, open_ = [], []
    for line in lines:
        if open_ and sum(map(len, open_)) + len(line) > 500:
            want.append(open_)
            open_ = []
        open_.append(line)
    want.append(open_)
    assert got == [(len(w), sum(map(len, w)), "\n\n".join(w)) for w in want]


def test_targets_without_a_schedule_get_one(spark):
    held = spark.createDataFrame([(5, "card", 1, 10, "review"), (9, "note", 1, 20, "new")], "schedule_id long, target_type string, target_id long, next_review long, state string")
    asked = [("card", 1, 2.0), ("card", 1, 1.0), ("card", 2, 3.0), ("note", 7, 0.5), ("note", 7, 0.5), ("note", None, 1.0), (None, 3, 1.0), ("note", 8, None)]
    requests = spark.createDataFrame(asked, "target_type string, target_id long, days double")
    got = sorted(tuple(r[c] for c in held.columns) for r in review.rescheduled(held, requests, 1000).collect())
    assert got == [(5, "card", 1, 87400, "review"), (9, "note", 1, 20, "new"), (10, "card", 2, 260200, "new"), (11, "note", 7, 44200, "new")]


def test_an_analysis_is_written_down(spark):
    runs = spark.createDataFrame([], SCHEMAS["distribution_runs"])
    plan = spark.createDataFrame([(1, "b", "skip"), (0, "a", "append")], "chunk_index long, text string, action string")
    runs = distribute.audited(distribute.audited(runs, plan, 4, 100), plan, 5, 101)
    after = {r.run_id: r for r in distribute.audit_applied(runs, 4, "{}", 200).collect()}
    assert {i: (r.draft_id, r.status, r.created_at, r.applied_at) for i, r in after.items()} == {1: (4, "applied", 100, 200), 2: (5, "analyzed", 101, None)}
    said = json.loads(after[1].plan_json)
    assert said["draft_id"] == 4 and [c["chunk_index"] for c in said["chunks"]] == [0, 1] and said["chunks"][0]["plan"] == {"text": "a", "action": "append"}


def test_prompts_show_whole_chunks_and_the_ids_of_candidates():
    text = "word " * 500
    said = prompts.distribution([(0, text, [(17, "Math")]), (1, "short", [])])
    assert text in said and "[17] Math" in said and "none" in said
    assert text in prompts.card_front(text)

import pytest
from pyspark.sql import functions as F

from notespark.functions import text as tx
from notespark.operators import calibration, distribute, fragments, fusion, hierarchy, indexing, keyword, review
from notespark.plans.retrieve import Config, retrieve, rewritten, variants
from notespark.sources.notes import read_markdown


def test_rrf_sums_weighted_reciprocal_ranks(spark):
    a = spark.createDataFrame([("A", 0), ("B", 1)], "id string, rank long")
    b = spark.createDataFrame([("B", 0), ("C", 1)], "id string, rank long")
    got = {r.id: r for r in fusion.rrf([fusion.ranked_list(a, 0, 1.0, "id"), fusion.ranked_list(b, 1, 0.5, "id")], "id", 60).collect()}
    assert got["B"].score == pytest.approx(1 / 62 + 0.5 / 61)
    assert got["A"].score == pytest.approx(1 / 61) and got["C"].score == pytest.approx(0.5 / 62)
    assert (got["B"].first_rank, got["B"].second_rank) == (1, 0) and got["A"].second_rank is None


def test_keyword_search_and_fallback(spark):
    rows = [(0, "Artificial neural networks learn"), (1, "Knowledge management with notes"), (2, "management of water")]
    docs = spark.createDataFrame(rows, "fragment_id long, clean_text string")
    assert [r.fragment_id for r in keyword.keyword_search(docs, "knowledge management", 5).collect()] == [1]
    assert {r.fragment_id for r in keyword.keyword_search(docs, "water networks", 5).collect()} == {0, 2}
    assert keyword.keyword_search(docs, "NOT", 5).count() == 0 == keyword.keyword_search(docs, "zz", 5).count()
    assert tx.query_tokens("What is the Atom?") == ["atom"] and tx.query_tokens("the") == ["the"]


def test_term_boost_counts_repeated_query_terms(spark):
    row = spark.createDataFrame([("An atom here",)], "t string")
    value = lambda terms, w: row.select(fusion.term_boost(F.col("t"), terms, w)).first()[0]
    assert value(["atom", "molecule"], 0.05) == pytest.approx(0.05)
    assert value(["atom"] * 30, 0.05) == 0.5 and value(["cell"], 0.05) == 0


def test_variants_merge_and_rewrite():
    assert rewritten("What is an atom?") == "an atom?" and rewritten("atom") is None
    config = Config(synonyms={"query text": ["query text ", "other"]})
    assert [(v.text, round(v.weight, 2)) for v in variants("Query text", config)] == [("Query text", 1.06), ("other", 0.6)]


def test_retrieve_modes(spark):
    docs = spark.createDataFrame([(0, "deep learning of networks"), (1, "cooking of rice"), (2, "learning to cook")], "fragment_id long, clean_text string")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.6, 0.8]), (3, [1.0])], "fragment_id long, embedding array<double>")
    best = lambda mode: [r.fragment_id for r in retrieve(docs, vectors, "learning", Config(mode=mode, top_k=2), (0.0, 1.0)).orderBy("rank").collect()]
    assert best("embedding") == [2, 1]  # the boost for a matching word outweighs ranks
    assert set(best("keyword")) == {0, 2} and best("hybrid")[0] == 2


def _tree(spark):
    rows = [(1, None, "Math"), (2, 1, "Linear Algebra"), (3, 1, "Calculus"), (4, 3, "Integration"), (5, None, "Economics")]
    return hierarchy.tree_paths(spark.createDataFrame(rows, "id long, parent_id long, name string"))


def test_due_counts_roll_up(spark):
    cards = spark.createDataFrame([(10, 1, "active"), (11, 2, "active"), (12, 4, "active"), (13, 2, "suspended")], "card_id long, note_id long, status string")
    schedules = spark.createDataFrame([("note", 3, 0), ("card", 10, 50), ("card", 11, 90), ("card", 12, 1100), ("card", 13, 1)], "target_type string, target_id long, next_review long")
    own = hierarchy.due_counts(schedules, cards, F.lit(100))
    got = {r.id: r.due for r in hierarchy.roll_up(_tree(spark), own, "due").collect()}
    assert got == {1: 3, 2: 1, 3: 1, 4: 0, 5: 0}


def test_repeat_tree(spark):
    cards = spark.createDataFrame([(1, 2, "active"), (2, 3, "active"), (3, 3, "active"), (4, 3, "active")], "card_id long, note_id long, status string")
    schedules = spark.createDataFrame([("card", 1, 5), ("card", 2, 5), ("card", 3, None), ("card", 4, 500)], "target_type string, target_id long, next_review long")
    got = {r.path: tuple(r)[2:] for r in hierarchy.repeat_tree(_tree(spark), schedules, cards, F.lit(100)).select("id", "path", "own_due", "own_total", "subtree_due", "subtree_total").collect()}
    assert got["Math"] == (0, 0, 2, 4) and got["Math/Linear Algebra"] == (1, 1, 1, 1)
    assert got["Math/Calculus"] == (1, 3, 1, 3) and got["Economics"] == (0, 0, 0, 0)


def test_moving_a_subtree(spark):
    closed = hierarchy.closure(_tree(spark))
    moved = {tuple(r) for r in hierarchy.moved_closure(closed, 3, 5).collect()}
    assert {(5, 3, 1), (5, 4, 2), (3, 4, 1)} <= moved and not {(1, 3), (1, 4)} & {x[:2] for x in moved}
    with pytest.raises(ValueError):
        hierarchy.moved_closure(closed, 3, 4)


def test_review_fold(spark):
    day = 86400
    rows = [(1, 0, 1, 3), (1, 3 * day, 2, 3), (1, 20 * day, 3, 1), (2, 0, 4, 1), (2, 100, 5, 4)]
    got = {r.schedule_id: r for r in review.fold_reviews(spark.createDataFrame(rows, "schedule_id long, reviewed_at long, review_id long, rating long")).collect()}
    assert (got[1].reps, got[1].lapses, got[1].state) == (3, 1, "review") and got[2].lapses == 1
    first = review.fold_reviews(spark.createDataFrame([(1, 0, 1, 3)], "schedule_id long, reviewed_at long, review_id long, rating long")).first()
    assert first.state == "learning" and first.stability == pytest.approx(2.3065) and first.next_review == int(2.3065 * day)


def test_fragment_changes_and_dedup(spark):
    old = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c")], "note_id long, order_index long, hash string")
    new = spark.createDataFrame([(1, 0, "a"), (1, 1, "x"), (2, 0, "d")], "note_id long, order_index long, hash string")
    got = {(r.note_id, r.order_index): r.change for r in indexing.fragment_changes(old, new).collect()}
    assert got == {(1, 0): "same", (1, 1): "update", (1, 2): "delete", (2, 0): "insert"}
    assert indexing.fragment_changes(new, new).where("change <> 'same'").count() == 0
    assert indexing.deduplicated(old.unionByName(old)).count() == 3


def test_packing_never_exceeds_the_budget_but_for_one_piece(spark):
    docs = spark.createDataFrame([(1, "aa\nbbb\n\ncccc\n" + "d" * 30 + "\ne")], "doc_id long, text string")
    got = [(r.n_pieces, r.size, r.text) for r in fragments.by_bytes(docs, 6).orderBy("fragment").collect()]
    assert got == [(2, 5, "aa\n\nbbb"), (1, 4, "cccc"), (1, 30, "d" * 30), (1, 1, "e")]


def test_sections_and_front_matter(spark):
    note = "---\nkey: v\n---\nintro\n## Math\ntext\n### Sub\nmore\n## Calculus\nend"
    meta, rest = fragments.front_matter(F.col("content"))
    rows = spark.createDataFrame([(1, note)], "note_id long, content string").select("note_id", meta.alias("meta"), rest.alias("content"))
    assert rows.first().meta == "key: v"
    assert [r.title for r in fragments.sections(rows).orderBy("pos").collect()] == [None, "Math", "Calculus"]


def test_cleaning(spark):
    given = "## Title\n\n\n- **bold** and [label](http://x)\n2. [[note|alias]] `code`\n---\nend"
    value = spark.createDataFrame([(given,)], "t string").select(tx.cleaned(F.col("t"))).first()[0]
    assert value == "title\nbold and label\nalias code\nend"


def test_calibration_prefers_the_expected(spark):
    hits = spark.createDataFrame([("q", 1, "A", "a", 1.0, 0, 1, 0.0), ("q", 2, "B", "a", 1.0, 1, 0, 0.0)],
                                 "query string, doc long, title string, expected string, relevance double, keyword_rank long, vector_rank long, boost_matches double")
    grid = spark.createDataFrame([(w, 60.0, 0.0) for w in (0.0, 2.0)], "w double, k double, tb double")
    queries = spark.createDataFrame([("q", 1.0), ("none", 1.0)], "query string, relevance double")
    ranked = calibration.fused_ranks(hits.drop("relevance"), grid)
    scores = calibration.mean_reciprocal_rank(ranked, queries)
    assert {r.w: r.mrr for r in scores.collect()} == {0.0: 0.5, 2.0: 0.25}
    assert calibration.best_point(scores).first().w == 0.0


def test_plans(spark):
    merging = [(1, 2), (2, 3), (3, None), (5, 6), (6, 5), (7, 6), (8, 99), (9, 9), *((i, i + 1) for i in range(1000, 1400)), (1400, None)]
    ends = distribute.resolve_merges(spark.createDataFrame(merging, "chunk_index long, merge_into long"))
    assert {r.chunk_index: r.end for r in ends.collect()} == {1: 3, 2: 3, 5: None, 6: None, 7: None} | {i: 1400 for i in range(1000, 1400)}
    chunks = spark.createDataFrame([(0, 0, "Calculus Limits"), (0, 1, "Calculus")], "draft_id long, chunk_index long, title string")
    assert {r.chunk_index: r.parent_index for r in distribute.parents_by_title(chunks).collect()} == {0: 1, 1: None}
    plan = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4)], "chunk_index long, parent_index long")
    assert {r.chunk_index: r.level for r in distribute.creation_levels(plan).collect()} == {1: 0, 2: 1, 3: 2, 4: 0, 5: 0}


def test_markdown_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "My note.md").write_text("# x\ny")
    (tmp_path / "skip.txt").write_text("z")
    rows = read_markdown(spark, str(tmp_path)).collect()
    assert [(r.title, r.content, r.indexing_status) for r in rows] == [("My note", "# x\ny", "pending")]

import json

import pytest
from pyspark.sql import functions as F

from notespark.functions import models
from notespark.functions import notes as notes_functions
from notespark.operators import cards, distribute, store, tags
from notespark.plans.retrieve import Config, Variant, ordered_by, resolved, retrieve, scored_by, variants, vault_language
from notespark.schemas import SCHEMAS
from notespark.sources.notes import import_markdown, indexed_or_failed


def _rows(spark, name, rows):
    """Rows of a table by the columns that matter; the others are null."""
    columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], SCHEMAS[name])


def _notes(spark):
    base = {"lifecycle": "active", "indexing_status": "indexed", "content": "x", "created_at": 0, "updated_at": 0}
    rows = [(1, None, "Math", "Math"), (2, 1, "Algebra", "Math/Algebra"), (3, 2, "Groups", "Math/Algebra/Groups"), (4, None, "Mathematics", "Mathematics")]
    return _rows(spark, "notes", [base | {"note_id": i, "parent_note_id": p, "title": t, "path_cached": c} for i, p, t, c in rows])


def _paths(rows, key="note_id"):
    return {r[key]: r.path_cached for r in rows.collect()}


def test_notes_are_renamed_and_moved(spark):
    notes = _notes(spark)
    args = ("note_id", "parent_note_id")
    assert _paths(store.paths_rewritten(notes, *args, 1, name="M")) == {1: "M", 2: "M/Algebra", 3: "M/Algebra/Groups", 4: "Mathematics"}
    moved = store.paths_rewritten(notes, *args, 2, new_parent=4, moved=True)
    assert _paths(moved) == {1: "Math", 2: "Mathematics/Algebra", 3: "Mathematics/Algebra/Groups", 4: "Mathematics"}
    assert _paths(store.paths_rewritten(notes, *args, 2, moved=True))[3] == "Algebra/Groups"
    for target in (1, 3):
        with pytest.raises(ValueError):
            store.paths_rewritten(notes, *args, 1, new_parent=target, moved=True)


def test_insert_status_and_lifecycle(spark):
    new = spark.createDataFrame([("Calculus", "text", 1), ("Root", "", None)], "title string, content string, parent_note_id long")
    after = store.inserted_notes(_notes(spark), new, 7)
    got = {r.title: (r.note_id, r.path_cached, r.indexing_status) for r in after.where("note_id > 4").collect()}
    assert got == {"Calculus": (5, "Math/Calculus", "pending"), "Root": (6, "Root", "pending")}
    one = spark.createDataFrame([(2,)], "note_id long")
    gone = store.with_lifecycle(store.with_status(after, one, "failed", "e"), one, "deleted", 9).where("note_id = 2").first()
    assert (gone.lifecycle, gone.indexing_status, gone.indexing_error, gone.updated_at) == ("deleted", "failed", "e", 9)
    assert store.point(after, "parent_note_id", None).count() == 3


def test_indexing_again_changes_nothing(spark):
    notes, none = _notes(spark), _rows(spark, "fragments", [])
    vectors = _rows(spark, "fragment_embeddings", [])
    new = spark.createDataFrame([(1, 0, "a", "a"), (1, 1, "b", "b")], "note_id long, order_index long, raw_text string, clean_text string")
    ids = spark.createDataFrame([(1,)], "note_id long")
    notes, first, vectors = store.indexed(notes, none, vectors, new, ids, "m", 4, 5)
    held = _rows(spark, "fragment_embeddings", [{"fragment_id": r.fragment_id, "embedding_model": "m", "embedding_model_version": "1", "dim": 1, "embedding": [1.0]} for r in first.collect()])
    _, again, left = store.indexed(notes, first, held, new, ids, "m", 4, 6)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect())) and left.count() == 2
    edited = new.withColumn("clean_text", F.when(F.col("order_index") == 1, "c").otherwise(F.col("clean_text")))
    _, after, left = store.indexed(notes, first, held, edited, ids, "m", 4, 6)
    assert after.count() == 2 and left.count() == 1
    assert {r.order_index: r.fragment_id for r in after.collect()} == {r.order_index: r.fragment_id for r in first.collect()}
    fewer, _ = store.indexed(notes, first, held, new.limit(0), ids, "m", 4, 6)[1:]
    assert fewer.count() == 0


def test_fragments_vectors_and_meta(spark):
    rows = _rows(spark, "fragments", [{"fragment_id": 5, "note_id": 1, "order_index": 0, "raw_text": "a", "clean_text": "a", "clean_text_hash": "h1"}])
    new = _rows(spark, "fragments", [{"note_id": 1, "order_index": i, "clean_text": "t", "clean_text_hash": h} for i, h in enumerate(["h1", "h2", "h2", "h3"])]).drop("fragment_id")
    after = store.inserted_fragments(rows, new)
    assert sorted((r.fragment_id, r.clean_text_hash) for r in after.collect()) == [(5, "h1"), (6, "h2"), (7, "h3")]
    assert store.fragment_id_of(after, 1, "h3") == 7 and store.fragment_id_of(after, 2, "h3") is None
    meta = spark.createDataFrame([("a", "1"), ("b", "x")], "key string, value string")
    meta = store.set_values(meta, {"a": "2.5", "c": "3"})
    assert store.get_float(meta, "a") == 2.5 and store.get_float(meta, "b") is None and store.get_value(meta, "zz") is None and meta.count() == 3
    assert resolved(Config(rrf_k=20.0), store.set_values(meta, {"retrieval_rrf_k": "40", "retrieval_embedding_weight": "2"})) == Config(rrf_k=20.0, embedding_weight=2.0)


def test_tags_of_strings_move_and_delete(spark):
    none = _rows(spark, "tags", []).select("tag_id", "parent_tag_id", "name", "slug", "depth", "path_cached")
    strings = lambda *xs: spark.createDataFrame([(x,) for x in xs], "path string")
    held, leaves = tags.resolved(none, strings("Chemistry/Microscope/Atom", " Important"))
    assert {r.path: r.tag_id for r in leaves.collect()} == {"chemistry/microscope/atom": 4, "important": 2}
    again, leaves = tags.resolved(held, strings("chemistry/microscope/Atom", "chemistry/new"))
    assert again.count() == held.count() + 1 and leaves.count() == 2
    atom, important = 4, 2
    moved = tags.moved(held, atom, important)
    assert _paths(moved, "tag_id")[atom] == "important/atom" and moved.where("tag_id = 4").first().depth == 1
    with pytest.raises(ValueError):
        tags.moved(moved, important, atom)
    named = tags.renamed(moved, important, "Highly-Important")
    assert _paths(named, "tag_id")[atom] == "highly-important/atom"
    links = spark.createDataFrame([(1, atom), (2, 1)], "note_id long, tag_id long")
    left, notes, _ = tags.deleted(named, links, links, important)
    assert left.count() == 2 and [r.note_id for r in notes.collect()] == [2]
    assert tags.closed(held).where("descendant_id = 4").count() == 3
    rows = tags.associated(_rows(spark, "note_tags", [{"note_id": 1, "tag_id": 4, "source": "user"}]), links.withColumn("confidence", F.lit(None)), "ai", 5)
    assert sorted((r.note_id, r.source) for r in rows.collect()) == [(1, "ai"), (2, "ai")]
    assert tags.dissociated(rows, links.limit(1)).count() == 1
    fragments = spark.createDataFrame([(10, 1), (11, 1)], "fragment_id long, note_id long")
    own = spark.createDataFrame([(10, atom, "user", 0)], "fragment_id long, tag_id long, source string, created_at long")
    full = tags.with_inherited(links, fragments, own, 5)
    assert full.count() == 2 and tags.without_inherited(links, fragments, full).count() == 1


def test_cards_and_cascades(spark):
    none, plans = _rows(spark, "cards", []), _rows(spark, "schedules", [])
    new = spark.createDataFrame([(1, 10, "heading"), (1, 11, "qa")], "note_id long, section_id long, card_type string")
    held, plans = cards.inserted(none, plans, new, 3)
    assert held.count() == 2 and {(r.target_id, r.state, r.next_review) for r in plans.collect()} == {(1, "new", None), (2, "new", None)}
    sections = lambda *xs: spark.createDataFrame([(x,) for x in xs], "id long")
    stale = cards.marked_stale(held, sections(10))
    assert {r.card_id: r.status for r in stale.collect()} == {1: "stale", 2: "fresh"}
    texts = spark.createDataFrame([(10, "H", "text")], "section_id long, heading string, text_raw string")
    fresh = cards.refreshed(stale, texts, lambda t, f, b: F.struct(F.upper(t).alias("front"), t.alias("back")), 4)
    assert (fresh.where("card_id = 1").first().custom_front, fresh.where("card_id = 1").first().status) == ("TEXT", "fresh")
    shown = {r.card_id: (r.front, r.back) for r in cards.rendered(held, texts, _notes(spark)).collect()}
    assert shown == {1: ("H", "text"), 2: ("", "")}
    rows = _rows(spark, "fragments", [{"fragment_id": 10, "note_id": 1, "raw_text": "old"}])
    left, _, orphaned = store.deleted_fragments(rows, _rows(spark, "fragment_embeddings", []), held, sections(10))
    assert left.count() == 0 and (orphaned.where("card_id = 1").first().status, orphaned.where("card_id = 1").first().last_section_snapshot) == ("orphaned", "old")
    logs = _rows(spark, "review_logs", [{"log_id": 1, "schedule_id": 1}])
    assert [df.count() for df in store.deleted_cards(held, plans, logs, sections(1))] == [1, 1, 0]
    assert cards.without_target(plans, "card", sections(2)).count() == 1 and cards.schedule_of(plans, "card", 2).count() == 1


def test_a_plan_is_applied(spark):
    notes = _notes(spark)
    chunks = spark.createDataFrame([(0, "to math"), (1, "calculus"), (2, "below"), (3, "more calculus")], "chunk_index long, text string")
    answers = [
        {"action": "append", "target_note_id": 1, "tags": ["#Math"], "reason": ""},
        {"action": "create_child", "parent_note_id": 1, "new_note_title": "Calculus", "tags": ["#Math/Calculus"], "reason": ""},
        {"action": "create_child", "parent_chunk_index": 1, "new_note_title": "Limits", "reason": ""},
        {"action": "merge_with_chunk", "chunk_index": 1, "reason": ""},
    ]
    candidates = spark.createDataFrame([(0, 1)], "chunk_index long, note_id long")
    plan = distribute.analyzed(chunks, candidates, notes, lambda prompt: "said " + json.dumps(answers))
    assert {r.chunk_index: r.action for r in plan.collect()} == {0: "append", 1: "create_child", 2: "create_child", 3: "merge_with_chunk"}
    tables = {"notes": notes, "note_revisions": _rows(spark, "note_revisions", []), "note_tags": _rows(spark, "note_tags", []),
              "tags": _rows(spark, "tags", []).select("tag_id", "parent_tag_id", "name", "slug", "depth", "path_cached")}
    after = distribute.applied(tables, plan, 4, 9, "T")
    got = {r.title: r for r in after["notes"].collect()}
    assert got["Math"].content == "x\n\n<!-- imported from draft #4 on T -->\nto math" and got["Math"].indexing_status == "pending"
    assert got["Calculus"].content == "calculus\n\nmore calculus" and got["Calculus"].path_cached == "Math/Calculus"
    assert got["Limits"].path_cached == "Math/Calculus/Limits" and got["Mathematics"].lifecycle == "archived"
    assert {r.path_cached for r in after["tags"].collect()} == {"math", "math/calculus"} and after["note_tags"].count() == 2
    assert after["note_revisions"].count() == 1
    lost = distribute.analyzed(chunks, candidates, notes, lambda prompt: "nothing")
    assert {r.action for r in lost.collect()} == {"skip"}
    assert distribute.applied(tables, lost, 4, 9, "T")["notes"].where("lifecycle = 'archived'").count() == 0


class _Models:
    def translate(self, query, language):
        return f"{query} {language}"

    def synonyms(self, query, language):
        return [query, "", "other words", "b", "c", "d"]

    def hypothesis(self, query, language):
        return "short" if query == "q" else "h" * 60

    def embed(self, texts):
        return [[1.0, 0.0]] * len(texts)


def test_variants_of_models():
    found = variants("what is x y", Config(), (0.0, 1.0), _Models(), "en", "ru")
    assert [(v.text, v.weight, v.vector_only) for v in found] == [
        ("what is x y", 0.5, False), ("x y", 0.45, False), ("what is x y ru", 1.5, False), ("other words", 0.3, False), ("b", 0.3, False), ("c", 0.3, False)]
    assert [v.text for v in variants("q", Config(auto_translate=False), None, _Models(), "en", "en")] == ["q", "other words", "b", "c"]
    assert variants("atoms", Config(), None, _Models(), "en", "en")[1] == Variant("h" * 60, 0.8 * 1.5, (1.0, 0.0), True, "en")


def test_deleted_notes_are_not_found_and_reranks_rerank(spark):
    notes = _notes(spark).withColumn("lifecycle", F.when(F.col("note_id") == 2, "deleted").otherwise(F.col("lifecycle")))
    rows = [(i, n, 0, t, t) for i, n, t in ((0, 1, "networks of atoms"), (1, 2, "networks of cells"), (2, 3, "a network of friends"), (3, 4, "nothing"))]
    fragments = spark.createDataFrame(rows, "fragment_id long, note_id long, order_index long, raw_text string, clean_text string")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.5, 0.5]), (3, [0.0, 1.0])], "fragment_id long, embedding array<double>")
    found = retrieve(fragments, vectors, "network", Config(explain=True, top_k=3), (1.0, 0.0), notes=notes, stem=True)
    got = {r.fragment_id: r for r in found.collect()}
    assert set(got) == {0, 2, 3} and got[0].note_title == "Math" and got[0].debug.vector_rank == 0 and got[0].debug.boost == 0.05
    assert [r.fragment_id for r in retrieve(fragments, vectors, "network", Config(), (1.0, 0.0), notes=notes, note_ids=[3]).collect()] == [2]
    first = lambda rerank: [r.fragment_id for r in retrieve(fragments, vectors, "network", Config(rerank=rerank, top_k=2), (1.0, 0.0), notes=notes).orderBy("rank").collect()]
    plain = first(None)
    assert first(ordered_by(lambda p: "[1, 0]", "network")) == plain[::-1]
    assert first(scored_by(lambda p: '[{"id": 2, "score": 10}]', "network"))[0] not in plain[:1]
    assert vault_language(spark.createDataFrame([("the cat is in the house and it was",), ("der Hund",)], "clean_text string")) == "en"


def test_imports_failures_and_updates(spark, tmp_path):
    (tmp_path / "a b.md").write_text("# x")
    after = import_markdown(spark, str(tmp_path), _notes(spark), 3)
    assert after.where("title = 'a b'").first().indexing_status == "pending" and after.count() == 5
    def cut(text):
        return [text] if text != "x" else 1 / 0
    got = {r.note_id: (r.fragments, r.error) for r in indexed_or_failed(after, cut).collect()}
    assert got[5] == (["# x"], None) and got[1][0] is None and got[1][1].startswith("ZeroDivisionError")
    rows = _rows(spark, "fragments", [{"fragment_id": i, "note_id": 1, "order_index": i, "clean_text": "t"} for i in range(3)])
    vectors = _rows(spark, "fragment_embeddings", [{"fragment_id": i} for i in range(3)])
    new = spark.createDataFrame([(1, 1, "r", "c")], "note_id long, order_index long, raw_text string, clean_text string")
    fragments, left = store.updated_fragments(rows, vectors, new, 5)
    assert {r.fragment_id: r.clean_text for r in fragments.collect()} == {0: "t", 1: "c", 2: "t"} and left.count() == 2
    assert store.updated_fragments(rows, vectors, new, 5, False)[1].count() == 3


def test_languages_models_and_formulas(spark):
    texts = {"en": "the cat is in the house", "de": "das ist nicht der Hund", "ru": "кошка в доме", "uk": "кішка в домі", "be": "ён быў у доме", "zh": "猫在房子里",
             "ja": "猫は家にいます", "it": "il gatto che non è della casa", "pt": "o gato não é da casa", "pl": "kot jest w domu i nie śpi", "nl": "de kat is niet in het huis"}
    assert {k: notes_functions.detect_language(v) for k, v in texts.items()} == {k: k for k in texts}
    assert notes_functions.detect_language("123") == "en" and not notes_functions.is_english("123") and notes_functions.is_english(texts["en"])
    row = spark.createDataFrame([(r"a $\alpha_1 \frac{x}{y}$ and $$\sum _{i}^{n} \vec{v} \foo z$$ ",)], "t string")
    assert row.select(notes_functions.plain_latex(F.col("t"))).first()[0] == "a α_1 (x)/(y) and ∑_i^n v\u20d7  z"
    embedder = models.loaded("hashing", dimension=8)
    assert models.loaded("hashing", dimension=8) is embedder
    with pytest.raises(ValueError):
        models.loaded("other")
    assert sum(x * x for x in models.query_vector("a query", embedder)) == pytest.approx(1)
    vector = row.select(models.embedded_passages(F.col("t"), embedder)).first()[0]
    assert sum(x * x for x in vector) == pytest.approx(1, abs=1e-5)
    assert models.translated("x", "ru", lambda p: " ") == "x" and models.chatted(lambda p: p, "q").endswith("q")

"""The registered queries for the library's own operators, on the driver's tables.

Documents stand for notes (their lines for fragments), region / nation / customer for the note tree,
orders for cards and schedules, part types and brands for tags, events for the review log.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import defaults as d
from .functions import text as tx
from .functions import notes as nt
from .functions.vectors import cosine, dot, from_blob, norm, normalized, to_blob
from .operators import calibration, cards, distribute, fragments, fusion, hierarchy, indexing, keyword, review, store, tags, vector
from .operators import titles as titles_search
from .operators.postings import KeywordIndex
from .plans import batch
from .plans.retrieve import Config, hybrid_search
from .tables import kept
from .streaming.expiry import streaming_cache_expiry
from .streaming.index import streaming_index_applied
from .streaming.jobs import streaming_index, streaming_reviews

SINGLE, SEVERAL, RARE = "heat", "heat thing", "zzqx thing"
LINES = "concat('## ', replace(text, ' ', '  '), chr(10), chr(10), '- **bold** [label](http://x) and [[note|alias]]', chr(10), '3. item `code`')"


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark, sf):
    return _t(spark, sf, "documents").select(F.col("doc_id").alias("fragment_id"), F.col("text").alias("clean_text"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def kw_bm25_single(spark, sf):
    return _rounded(keyword.keyword_search(_docs(spark, sf), SINGLE, 20), "bm25")


def kw_bm25_and(spark, sf):
    return _rounded(keyword.keyword_search(_docs(spark, sf), SEVERAL, 20), "bm25")


def kw_bm25_or_fallback(spark, sf):
    return _rounded(keyword.keyword_search(_docs(spark, sf), RARE, 20), "bm25")


def kw_match_counts(spark, sf):
    return keyword.match_counts(_docs(spark, sf), ["the", "license", "tion"])


def kw_posting_search(spark, sf):
    """The same search as ``kw_bm25_and``, in an index of trigrams with places."""
    asked = spark.createDataFrame([(0, SEVERAL)], "query_id int, text string")
    found = KeywordIndex.built(_docs(spark, sf)).search(asked, 20)
    return _rounded(found.drop("query_id"), "bm25")


def _changed_docs(spark, sf):
    """Documents after a change: every seventh is gone, every fifth other has a new text, some are new."""
    docs, i = _docs(spark, sf), F.col("fragment_id")
    more = F.concat("clean_text", F.lit(" heat"))
    updated = docs.where((i % 5 == 0) & (i % 7 != 0)).select("fragment_id", more.alias("clean_text"))
    added = docs.where(i % 11 == 0).select((i + 10_000_000).alias("fragment_id"), "clean_text")
    return docs.where(i % 7 == 0).select("fragment_id"), updated.unionByName(added)


def kw_posting_after_change(spark, sf):
    """The search in an index that took the change in three more generations, one of them twice."""
    docs = _docs(spark, sf)
    gone, new = _changed_docs(spark, sf)
    index = KeywordIndex.built(docs)
    index.change(1, docs.where("fragment_id % 3 = 0").select("fragment_id", F.lit("heat thing").alias("clean_text")))
    index.change(2, docs.where("fragment_id % 3 = 0"))  # and back again
    for _ in range(2):
        index.change(3, new, gone)
    asked = spark.createDataFrame([(0, SEVERAL)], "query_id int, text string")
    return _rounded(index.search(asked, 20).drop("query_id"), "bm25")


def kw_posting_batch(spark, sf):
    """The best ten documents for the text of every benchmark item, in one search."""
    asked = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return _rounded(KeywordIndex.built(_docs(spark, sf)).search(asked, 10), "bm25")


def _asked_table(spark, sf):
    """A query of every twentieth document: four of its words, and the vector of its number."""
    docs = _t(spark, sf, "documents").where("doc_id % 20 = 0")
    text = F.array_join(F.slice(tx.query_words(F.col("text")), 1, 4), " ")
    vectors = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return docs.select("doc_id", text.alias("text")).join(vectors, "doc_id", "left").withColumnRenamed("doc_id", "query_id")


def _fragment_vectors(spark, sf):
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("fragment_id"), "embedding")


def hybrid_search_table(spark, sf):
    """Hybrid retrieval of a table of queries, in one plan."""
    docs = _docs(spark, sf)
    asked = batch.variant_table(_asked_table(spark, sf))
    found = batch.retrieve_table(docs, KeywordIndex.built(docs), _fragment_vectors(spark, sf), asked, Config(top_k=5))
    return _rounded(found, "score")


def prefetched_hits(spark, sf):
    """The input of a calibration: the ranks of the best hits of either branch for a table of queries."""
    return batch.prefetched(KeywordIndex.built(_docs(spark, sf)), _fragment_vectors(spark, sf), _asked_table(spark, sf), 20)


def calibration_of_hits(spark, sf):
    """The grid over prefetched keyword and vector hits; a query expects the language of its document."""
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.concat("lang", F.lit("/"), "source").alias("title"))
    hits = prefetched_hits(spark, sf).withColumnRenamed("fragment_id", "doc").withColumnRenamed("query_id", "query")
    wanted = docs.select(F.col("doc").alias("query"), F.col("title").alias("expected"))
    rows = kept(hits.join(docs, "doc").join(wanted, "query").withColumn("boost_matches", (F.col("doc") % 3).cast("double")))
    queries = docs.where("doc % 20 = 0").select(F.col("doc").alias("query"), F.lit(1.0).alias("relevance"))
    return _rounded(calibration.grid_scores(rows, queries, calibration.grid(spark)), "mrr")


def fuzzy_titles(spark, sf):
    """The five best titles for abbreviations of every twentieth part's name."""
    parts = _t(spark, sf, "part")
    words = F.split("p_name", " ")
    short = F.concat(F.substring(words[0], 1, 2), F.substring(words[1], 1, 3), F.lower(F.substring("p_type", 1, 1)))
    titles = parts.select(F.col("p_partkey").alias("note_id"), F.concat("p_name", F.lit(" / "), F.initcap("p_type"), F.lit("-"), F.col("p_size")).alias("title"))
    return titles_search.fuzzy_search(titles, parts.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), short.alias("query")), 5)


def kw_snippets(spark, sf):
    """The best window of each document that holds a word of the query."""
    rows = _docs(spark, sf).where("lower(clean_text) LIKE '%heat%' OR lower(clean_text) LIKE '%thing%'")
    return rows.select("fragment_id", keyword.snippet(F.col("clean_text"), SEVERAL).alias("snippet"))


def _query_vectors(spark, sf):
    rows = _t(spark, sf, "embeddings").where(F.col("vec_id") % 20 == 0)
    return rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def vec_topk_dot(spark, sf):
    q = [1.0 if i % 2 else -0.5 for i in range(64)]
    return _rounded(vector.vector_search(_t(spark, sf, "embeddings"), q, 10), "similarity")


def vec_topk_batch(spark, sf):
    return _rounded(vector.vector_search_batch(_t(spark, sf, "embeddings"), _query_vectors(spark, sf), 5), "similarity")


def vec_cosine_pairs(spark, sf):
    a = _t(spark, sf, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    value = cosine(F.transform("embedding", lambda x: x * 3), F.col("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(value, 6).alias("similarity"))


def l2_norms(spark, sf):
    scaled = F.transform("embedding", lambda x: x.cast("double") * 2)
    unit = normalized(scaled)
    return _t(spark, sf, "embeddings").select("vec_id", F.round(norm(scaled), 6).alias("length"), F.round(norm(unit), 6).alias("unit_length"))


def vec_dim_guard(spark, sf):
    rows = _t(spark, sf, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")))
    return vector.vector_search(rows, [1.0] * 64, 1000000).agg(F.count(F.lit(1)).alias("n"))


def semantic_merge_groups(spark, sf):
    return vector.merge_neighbours(_t(spark, sf, "embeddings"), 0.1, "label", "vec_id").select("label", "vec_id", "group")


def best_per_group_top3(spark, sf):
    hits = vector.vector_search(_t(spark, sf, "embeddings"), [1.0] * 64, 50).join(_t(spark, sf, "embeddings").select("vec_id", "label"), "vec_id")
    return _rounded(vector.best_groups(hits, "label", "similarity", 3), "similarity")


def _best(df: DataFrame, order, most: int) -> DataFrame:
    """The first ``most`` rows with their rank; only they are brought together."""
    along = Window.partitionBy(F.lit(0)).orderBy(*order)
    return df.orderBy(*order).limit(most).withColumn("rank", (F.row_number().over(along) - 1).cast("long"))


def _two_lists(spark, sf):
    e = _t(spark, sf, "embeddings")
    part = lambda i: e.select("vec_id", F.round(F.col("embedding")[i].cast("double"), 6).alias("s"))
    return _best(part(0), [F.desc("s"), "vec_id"], 50), _best(part(1), [F.desc("s"), "vec_id"], 50)


def rrf_two_lists(spark, sf):
    a, b = _two_lists(spark, sf)
    return _rounded(fusion.rrf([fusion.ranked_list(a, 0, 1.0, "vec_id"), fusion.ranked_list(b, 1, 1.5, "vec_id")], "vec_id", 60.0, 20), "score")


def rrf_weighted_k(spark, sf):
    a, b = _two_lists(spark, sf)
    fused = fusion.rrf([fusion.ranked_list(a, 0, 0.7, "vec_id"), fusion.ranked_list(b, 1, 0.2, "vec_id")], "vec_id", 10.0)
    return _rounded(fused.select("vec_id", "score"), "score")


def term_boost(spark, sf):
    boosted = fusion.term_boost(F.col("clean_text"), ["the", "heat", "the", "of", "zzqx"])
    return _rounded(_docs(spark, sf).select("fragment_id", boosted.alias("boost")), "boost")


def _scored(spark, sf):
    return _t(spark, sf, "embeddings").select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("score"))


def ratio_cutoff(spark, sf):
    return fusion.ratio_cutoff(_scored(spark, sf), 0.5, within=["label"])


def min_score_filter(spark, sf):
    return fusion.min_score(_scored(spark, sf), 0.1, 15, "vec_id")


def scoring_rerank(spark, sf):
    given = _t(spark, sf, "embeddings").where("vec_id % 4 = 0").select("vec_id", (F.col("vec_id") % 11).alias("points"))
    return _rounded(fusion.scoring_rerank(_scored(spark, sf), given, "vec_id"), "score")


def listwise_rerank(spark, sf):
    top = _best(_scored(spark, sf), [F.desc("score"), "vec_id"], 25)
    order = top.where("rank % 3 = 1").select("vec_id", (100 - F.col("rank")).alias("place"))
    return _rounded(fusion.listwise_rerank(top, order, "vec_id").select("vec_id", "rank", "score"), "score")


def _calibration_hits(spark, sf):
    """Every twentieth vector asks; the hits of each branch are the best 50 of all vectors, by the first
    half of the dimensions and by all of them."""
    e = _t(spark, sf, "embeddings").withColumn("label", F.col("label").cast("string"))
    half = lambda df, c: df.withColumn(c, F.slice(c, 1, 32))
    asked = _query_vectors(spark, sf)
    most = d.FUSION_CANDIDATES
    branch = lambda rows, queries, name: vector.vector_search_batch(rows, queries, most).select("query_id", "vec_id", F.col("rank").alias(name))
    keyword_hits = branch(half(e, "embedding"), half(asked, "query"), "keyword_rank")
    hits = keyword_hits.join(branch(e, asked, "vector_rank"), ["query_id", "vec_id"], "full")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("label").alias("expected"))
    hits = hits.withColumnRenamed("query_id", "query").withColumnRenamed("vec_id", "doc")
    hits = hits.join(q, "query").join(e.select(F.col("vec_id").alias("doc"), F.col("label").alias("title")), "doc")
    hits = hits.withColumn("boost_matches", (F.col("doc") % 3).cast("double"))
    queries = q.select("query", F.when(F.col("query") % 40 == 0, 1.0).otherwise(0.9).alias("relevance"))
    return hits, queries


def mrr_eval(spark, sf):
    hits, queries = _calibration_hits(spark, sf)
    return _rounded(calibration.grid_scores(hits, queries, calibration.grid(spark)), "mrr")


def grid_search_best(spark, sf):
    return calibration.best_point(mrr_eval(spark, sf))


def min_score_calibrated(spark, sf):
    hits, _ = _calibration_hits(spark, sf)
    point = calibration.grid(spark).where("w = 1.5 AND k = 60 AND tb = 0.05")
    return _rounded(calibration.calibrated_min_score(calibration.fused_ranks(hits, point)), "min_score")


def token_counts(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", tx.n_tokens(F.col("text")).alias("n"))


def _marked(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.expr(LINES.replace("chr(10)", "'\\n'")).alias("text"))


def clean_markdown(spark, sf):
    return _marked(spark, sf).select("doc_id", tx.content_hash(tx.cleaned(F.col("text"))).alias("h"))


def collapse_blank_lines(spark, sf):
    return _marked(spark, sf).select("doc_id", tx.content_hash(tx.blank_lines_collapsed(F.col("text"))).alias("h"))


def strip_links(spark, sf):
    return _marked(spark, sf).select("doc_id", tx.content_hash(tx.links_to_labels(F.col("text"))).alias("h"))


def list_markers(spark, sf):
    return _marked(spark, sf).select("doc_id", tx.content_hash(tx.numbers_dropped(tx.list_markers_dropped(F.col("text")))).alias("h"))


def heading_markers(spark, sf):
    return _marked(spark, sf).select("doc_id", tx.content_hash(tx.heading_marks_dropped(F.col("text"))).alias("h"))


def latex_strip(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", tx.content_hash(tx.latex_dropped(F.col("text"))).alias("h"))


def fragment_lines(spark, sf):
    return fragments.lines(_t(spark, sf, "documents")).select("doc_id", "pos", tx.content_hash(F.col("line")).alias("h"))


def pack_char_budget(spark, sf):
    packed = fragments.by_bytes(_t(spark, sf, "documents"), 800)
    return packed.select("doc_id", "fragment", "n_pieces", "size", tx.content_hash(F.col("text")).alias("h"))


def pack_token_budget(spark, sf):
    packed = fragments.by_tokens(_t(spark, sf, "documents"), 256)
    return packed.select("doc_id", "fragment", "n_pieces", "size")


def _hashed_lines(spark, sf):
    rows = fragments.lines(_t(spark, sf, "documents"))
    return rows.select(F.col("doc_id").alias("note_id"), F.col("pos").alias("order_index"), tx.content_hash(F.col("line")).alias("hash"))


def dedup_fragments(spark, sf):
    return indexing.deduplicated(_hashed_lines(spark, sf))


def content_hash_dups(spark, sf):
    hashed = _t(spark, sf, "documents").select(tx.content_hash(F.col("text")).alias("h"))
    return hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def incremental_diff(spark, sf):
    """All lines of all notes; edits, deletions and insertions are spread over whole notes."""
    rows = _hashed_lines(spark, sf)
    old = rows.where("note_id % 5 <> 0")
    edited = F.when(F.col("order_index") % 5 == 2, F.sha2("hash", 256)).otherwise(F.col("hash"))
    new = rows.where("note_id % 7 <> 0 AND order_index % 11 <> 10").withColumn("hash", edited)
    inserted = rows.where("note_id % 7 <> 0 AND order_index % 13 = 0").withColumn("order_index", F.col("order_index") + 1000000)
    return indexing.fragment_changes(old, new.unionByName(inserted)).groupBy("note_id", "change").agg(F.count(F.lit(1)).alias("n"))


def _notes(spark, sf):
    docs, lab = _t(spark, sf, "documents"), _t(spark, sf, "labels")
    status = F.when(F.col("doc_id") % 4 == 0, "pending").when(F.col("doc_id") % 9 == 0, "failed").otherwise("indexed")
    model = F.when(F.col("quality") == 1, "m1").when(F.col("quality") == 0, "m0")
    return docs.join(lab, "doc_id", "left").select(
        "doc_id", status.alias("indexing_status"), model.alias("embedding_model"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("1")).alias("indexing_version"),
        F.when(F.col("doc_id") % 3 == 0, 1024).when(F.col("doc_id") % 3 == 1, 64).alias("embedding_dimension"),
        F.when(F.col("doc_id") % 10 == 0, "deleted").otherwise("active").alias("lifecycle"))


def needs_indexing(spark, sf):
    return _notes(spark, sf).select("doc_id", indexing.needs_indexing("m1", "1").alias("needs"))


def drift_stale(spark, sf):
    return _notes(spark, sf).where(indexing.drifted("m1", 1024)).select("doc_id")


def cache_hit_miss(spark, sf):
    hashed = _t(spark, sf, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("h"))
    cache = hashed.where("doc_id % 3 = 0").select("h", F.lit("m1").alias("model"), F.lit(7).alias("value"))
    found = indexing.cache_lookup(hashed.withColumn("model", F.lit("m1")), cache, ["h", "model"], "value")
    return found.groupBy("hit").agg(F.count(F.lit(1)).alias("n"))


def cache_ttl(spark, sf):
    rows = _t(spark, sf, "events").select("event_id", F.col("event_type").alias("model"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("created_at"))
    return indexing.fresh_cache(rows, "click", 1707600000).agg(F.count(F.lit(1)).alias("n"))


def lang_mode(spark, sf):
    rows = _t(spark, sf, "documents").where(F.octet_length("text") >= 10)
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(1)


def _tree(spark, sf):
    r = _t(spark, sf, "region").select((F.col("r_regionkey") + 10**9).cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.col("r_name").alias("name"))
    n = _t(spark, sf, "nation").select((F.col("n_nationkey") + 2 * 10**9).cast("long").alias("id"), (F.col("n_regionkey") + 10**9).cast("long").alias("parent_id"), F.col("n_name").alias("name"))
    c = _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") + 2 * 10**9).cast("long").alias("parent_id"), F.col("c_name").alias("name"))
    return r.unionByName(n).unionByName(c)


def _cards(spark, sf):
    o = _t(spark, sf, "orders")
    cards = o.select(F.col("o_orderkey").alias("card_id"), F.col("o_custkey").alias("note_id"), F.when(F.col("o_orderstatus") == "F", "suspended").otherwise("active").alias("status"))
    at = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    state = F.when(F.col("o_orderkey") % 5 > 0, "review").otherwise("new").alias("state")
    schedules = o.select(F.lit("card").alias("target_type"), F.col("o_orderkey").alias("target_id"), F.when(F.col("o_orderkey") % 5 > 0, at).alias("next_review"), state)
    noted = o.where("o_orderkey % 11 = 0").select(F.lit("note").alias("target_type"), F.col("o_custkey").alias("target_id"), at.alias("next_review"), state)
    return cards, schedules.unionByName(noted)


NOW = 820454400


def note_tree_paths(spark, sf):
    return hierarchy.tree_paths(_tree(spark, sf)).select("id", "path", "depth")


def descendant_pairs(spark, sf):
    return hierarchy.closure(hierarchy.tree_paths(_tree(spark, sf)))


def hierarchical_due_counts(spark, sf):
    cards, schedules = _cards(spark, sf)
    own = hierarchy.due_counts(schedules, cards, F.lit(NOW))
    return hierarchy.roll_up(hierarchy.tree_paths(_tree(spark, sf)), own, "due")


def repeat_mode_tree(spark, sf):
    cards, schedules = _cards(spark, sf)
    tree = hierarchy.repeat_tree(hierarchy.tree_paths(_tree(spark, sf)), schedules, cards, F.lit(NOW))
    return tree.withColumnRenamed("name", "title")


def _lived_notes(spark, sf):
    """The tree with a lifecycle, and the paths that all notes have cached."""
    paths = hierarchy.tree_paths(_tree(spark, sf)).select("id", "parent_id", "name", "path")
    return paths.withColumn("lifecycle", F.when(F.col("id") % 13 == 0, "deleted").when(F.col("id") % 17 == 0, "draft").otherwise("active"))


def visible_due_counts(spark, sf):
    cards, schedules = _cards(spark, sf)
    return hierarchy.visible_due_counts(_lived_notes(spark, sf), schedules, cards, F.lit(NOW))


def active_repeat_tree(spark, sf):
    cards, schedules = _cards(spark, sf)
    return hierarchy.active_repeat_tree(_lived_notes(spark, sf), schedules, cards, F.lit(NOW))


def reschedule(spark, sf):
    """Schedules after requests for every fourth card, some twice, and for notes that had none."""
    _, rows = _cards(spark, sf)
    i = F.col("target_id")
    schedules = rows.where("target_type = 'card'").withColumn("schedule_id", i * 2)
    cards = rows.where("target_type = 'card' AND target_id % 4 = 0").select("target_type", "target_id", (i % 30).cast("double").alias("days"))
    again = cards.where(i % 8 == 0).withColumn("days", F.col("days") + 5)
    fresh = _t(spark, sf, "supplier").select(F.lit("note").alias("target_type"), (F.col("s_suppkey") + 10**8).alias("target_id"), F.lit(0.5).alias("days"))
    found = review.rescheduled(schedules, cards.unionByName(again).unionByName(fresh), NOW)
    return found.select("schedule_id", "target_type", "target_id", "next_review", "state")


def merge_ends(spark, sf):
    """Where chains of merges end: most customers merge into the one before; some chains end in a circle."""
    c = F.col("c_custkey")
    into = F.when(c % 10 == 0, None).when(c % 50 == 7, c + 1).when(c % 77 == 0, -5).otherwise(c - 1)
    return distribute.resolve_merges(_t(spark, sf, "customer").select(c.alias("chunk_index"), into.alias("merge_into")))


def due_queue(spark, sf):
    _, schedules = _cards(spark, sf)
    rows = schedules.where("target_type = 'card'").select(F.col("target_id").alias("schedule_id"), "next_review")
    return review.due(rows, NOW, 25)


def due_count(spark, sf):
    _, schedules = _cards(spark, sf)
    return review.due(schedules, NOW).agg(F.count(F.lit(1)).alias("n"))


def _tag_levels(spark, sf):
    strings = _t(spark, sf, "part").select(F.concat_ws("/", F.replace("p_type", F.lit(" "), F.lit("/")), "p_brand").alias("path"))
    return hierarchy.tags_of_strings(strings)


def tag_closure_build(spark, sf):
    t = _tag_levels(spark, sf)
    nodes = t.select(F.col("path").alias("id"), F.col("parent_path").alias("parent_id"), "name")
    return hierarchy.closure(hierarchy.tree_paths(nodes))


def tag_autocomplete(spark, sf):
    t = _tag_levels(spark, sf).select(F.col("path").alias("tag_id"), "path", "name", "depth")
    links = _t(spark, sf, "part").select(F.lower(F.concat_ws("/", F.replace("p_type", F.lit(" "), F.lit("/")), "p_brand")).alias("tag_id"))
    return hierarchy.autocomplete(t, links, "Brand#1", 10).select("tag_id", "depth", "uses")


def tag_subtree_notes(spark, sf):
    closed = tag_closure_build(spark, sf)
    links = _t(spark, sf, "part").select(F.col("p_partkey").alias("note_id"), F.lower(F.concat_ws("/", F.replace("p_type", F.lit(" "), F.lit("/")), "p_brand")).alias("tag_id"))
    first = F.lower(F.split(F.lit("STANDARD"), " ")[0])
    return hierarchy.tagged(links, closed, first)


def tag_inherit_anti(spark, sf):
    notes = _t(spark, sf, "part").select(F.col("p_partkey").alias("note_id"), F.col("p_brand").alias("tag_id"))
    li = _t(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fragment_id"), F.col("l_partkey").alias("note_id")).distinct()
    has = li.join(notes, "note_id").where("fragment_id % 3 = 0").select("fragment_id", "tag_id")
    return hierarchy.inherited(notes, li, has).groupBy("tag_id").agg(F.count(F.lit(1)).alias("n"))


def tag_move_closure(spark, sf):
    return hierarchy.moved_closure(hierarchy.closure(hierarchy.tree_paths(_tree(spark, sf))), 10**9 + 1, 2 * 10**9)


def hashtag_extract(spark, sf):
    rows = _t(spark, sf, "documents").select("doc_id", F.concat(F.lit("#a/"), "lang", F.lit(" #x-y_1, # no #"), "source").alias("text"))
    return rows.select("doc_id", F.array_join(tx.hashtags(F.col("text")), "|").alias("tags"))


def json_payload(spark, sf):
    raw = F.concat(F.lit("said: "), "props", F.lit(" done"))
    value = F.get_json_object(tx.json_payload(raw), "$.k").cast("long")
    return _t(spark, sf, "events").select("event_id", value.alias("k"))


def _reviews(spark, sf):
    rating = F.when(F.col("event_id") % 7 == 0, 1).otherwise(F.col("event_id") % 3 + 2)
    return _t(spark, sf, "events").select(F.col("user_id").alias("schedule_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("reviewed_at"), F.col("event_id").alias("review_id"), rating.cast("long").alias("rating"))


def review_state_fold(spark, sf):
    folded = review.fold_reviews(_reviews(spark, sf))
    return folded.select("schedule_id", F.round("stability", 4).alias("stability"), F.round("difficulty", 4).alias("difficulty"), "reps", "lapses", "state", "last_reviewed")


def plan_append_concat(spark, sf):
    targets = _t(spark, sf, "customer").select(F.col("c_custkey").alias("note_id"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")).otherwise("").alias("content"))
    chunks = _t(spark, sf, "orders").select(F.col("o_custkey").alias("target_id"), F.col("o_orderkey").alias("chunk_index"), F.col("o_orderpriority").alias("text"))
    return distribute.appended(targets, chunks, 7, "2024-01-01T00:00:00+00:00").select("note_id", tx.content_hash(F.col("content")).alias("h"))


def heuristic_parent(spark, sf):
    chunks = _t(spark, sf, "part").select((F.col("p_partkey") % 200).alias("draft_id"), F.col("p_partkey").alias("chunk_index"), F.concat_ws(" ", "p_type", F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand"))).alias("title"))
    return distribute.parents_by_title(chunks)


def plan_create_child_levels(spark, sf):
    rows = _t(spark, sf, "part").select(F.col("p_partkey").alias("chunk_index"), F.when(F.col("p_partkey") % 10 > 0, F.when(F.col("p_partkey") % 10 == 7, F.col("p_partkey")).otherwise(F.col("p_partkey") - 1)).alias("parent_index"))
    return distribute.creation_levels(rows)


def fetch_page(spark, sf):
    return indexing.page(_t(spark, sf, "documents").select("doc_id", "lang"), ["lang", "doc_id"], 40, 25)


def _note_table(spark, sf):
    """Documents as notes, every tenth of them deleted, every ninth being indexed."""
    status = F.when(F.col("doc_id") % 9 == 0, "indexing").otherwise("indexed")
    return _t(spark, sf, "documents").select(
        F.col("doc_id").alias("note_id"), F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("content"),
        F.lit(None).cast("long").alias("parent_note_id"), F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("path_cached"), status.alias("indexing_status"), F.lit(None).cast("string").alias("indexing_error"),
        F.lit(0).cast("long").alias("indexed_at"), F.when(F.col("doc_id") % 3 == 0, "m0").otherwise("m1").alias("embedding_model"), F.lit(64).alias("embedding_dimension"),
        F.lit("1").alias("indexing_version"), F.when(F.col("doc_id") % 10 == 0, "deleted").otherwise("active").alias("lifecycle"), tx.content_hash(F.col("text")).alias("content_hash"),
        F.lit(0).cast("long").alias("created_at"), F.lit(0).cast("long").alias("updated_at"))


def _fragment_table(spark, sf):
    """The documents' lines as fragments, a number in a hundred thousand for each."""
    rows = fragments.lines(_t(spark, sf, "documents")).where("doc_id % 5 <> 0")
    return rows.select(
        (F.col("doc_id") * 100000 + F.col("pos")).alias("fragment_id"), F.col("doc_id").alias("note_id"), F.col("pos").cast("long").alias("order_index"), F.col("line").alias("raw_text"),
        tx.content_hash(F.col("line")).alias("raw_text_hash"), F.col("line").alias("clean_text"), tx.content_hash(F.col("line")).alias("clean_text_hash"),
        F.lit(0).cast("long").alias("created_at"), F.lit(0).cast("long").alias("updated_at"))


def _embedding_table(spark, sf):
    rows = _fragment_table(spark, sf).where("fragment_id % 2 = 0")
    return rows.select("fragment_id", F.lit("m1").alias("embedding_model"), F.lit("1").alias("embedding_model_version"), F.lit(2).alias("dim"), F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("embedding"), F.lit(0).cast("long").alias("embedded_at"))


def _ids(spark, sf, condition):
    return _t(spark, sf, "documents").where(condition).select(F.col("doc_id").alias("note_id"))


def active_search(spark, sf):
    """Three queries at once over fragments of notes of which a tenth is deleted."""
    rows = _docs(spark, sf).withColumn("live", F.col("fragment_id") % 10 != 0)
    return _rounded(keyword.keyword_search_batch(rows, {0: SINGLE, 1: SEVERAL, 2: RARE}, 20, live="live"), "bm25")


def index_apply(spark, sf):
    """Fragments after the notes were indexed again with edited, deleted and added lines."""
    lines = fragments.lines(_t(spark, sf, "documents")).where("doc_id % 7 <> 0 AND pos % 11 <> 10")
    text = F.when(F.col("pos") % 5 == 2, F.concat(F.lit("edited "), "line")).otherwise(F.col("line"))
    new = lines.select(F.col("doc_id").alias("note_id"), F.col("pos").cast("long").alias("order_index"), text.alias("raw_text"), text.alias("clean_text"))
    _, after, vectors = store.indexed(_note_table(spark, sf), _fragment_table(spark, sf), _embedding_table(spark, sf), new, _ids(spark, sf, "doc_id % 3 <> 0"), "m1", 64, 5)
    held = vectors.select(F.col("fragment_id").alias("_id"))
    joined = after.join(held, F.col("fragment_id") == F.col("_id"), "left")
    return joined.select("fragment_id", "note_id", "order_index", "clean_text_hash", F.col("_id").isNotNull().alias("has_vector"))


def drift_apply(spark, sf):
    notes, vectors = store.marked_for_model(_note_table(spark, sf), _fragment_table(spark, sf), _embedding_table(spark, sf), "m1", 64)
    left = vectors.select(F.floor(F.col("fragment_id") / 100000).alias("_note")).groupBy("_note").agg(F.count(F.lit(1)).alias("n"))
    return notes.join(left, F.col("note_id") == F.col("_note"), "left").select("note_id", "indexing_status", "indexed_at", F.coalesce("n", F.lit(0)).cast("long").alias("n_vectors"))


def crash_recovery(spark, sf):
    notes, rows = store.recovered(_note_table(spark, sf), _fragment_table(spark, sf))
    counts = store.fragment_counts(rows).withColumnRenamed("note_id", "_note")
    return notes.join(counts, F.col("note_id") == F.col("_note"), "left").select("note_id", "indexing_status", "indexing_error", F.coalesce("n_fragments", F.lit(0)).cast("long").alias("n"))


def fetch_joined(spark, sf):
    rows = store.fetch(_fragment_table(spark, sf), _note_table(spark, sf), _embedding_table(spark, sf), "m1", offset=40, limit=200)
    return rows.select("fragment_id", "note_title", "order_index", F.col("embedding").isNotNull().alias("has_vector"))


def content_update(spark, sf):
    """Every sixth note gets a new content; equal ones change nothing."""
    docs = _t(spark, sf, "documents").where("doc_id % 6 = 0")
    new = docs.select(F.col("doc_id").alias("note_id"), F.when(F.col("doc_id") % 12 == 0, F.concat("text", F.lit("\n\nmore"))).otherwise(F.col("text")).alias("content"))
    revisions = spark.createDataFrame([], "revision_id long, note_id long, patch string, created_at long")
    notes, patches = store.with_content(_note_table(spark, sf), revisions, new, 9)
    added = patches.select(F.col("note_id").alias("_note"), "revision_id", F.col("patch").contains("+more").alias("adds"))
    return notes.join(added, F.col("note_id") == F.col("_note"), "left").select("note_id", "content_hash", "indexing_status", "updated_at", "revision_id", "adds")


def delete_cascade(spark, sf):
    """What is left of each table after every fourth note was deleted for good."""
    rows = _fragment_table(spark, sf)
    cards = rows.where("order_index < 2").select(F.col("fragment_id").alias("card_id"), "note_id", F.col("fragment_id").alias("section_id"), F.lit("fresh").alias("status"), F.lit(None).cast("string").alias("last_section_snapshot"))
    plans = cards.select(F.col("card_id").alias("schedule_id"), F.lit("card").alias("target_type"), F.col("card_id").alias("target_id"))
    logs = plans.select(F.col("schedule_id").alias("log_id"), "schedule_id")
    tables = {"notes": _note_table(spark, sf), "fragments": rows, "fragment_embeddings": _embedding_table(spark, sf), "cards": cards, "schedules": plans, "review_logs": logs}
    after = store.deleted_notes(tables, _ids(spark, sf, "doc_id % 4 = 0"))
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in after.items()]
    return reduce(DataFrame.unionByName, counts)


def _tag_table(spark, sf):
    strings = _t(spark, sf, "part").select(F.concat_ws("/", F.replace("p_type", F.lit(" "), F.lit("/")), "p_brand").alias("path"))
    empty = spark.createDataFrame([], "tag_id long, parent_tag_id long, name string, slug string, depth int, path_cached string")
    return tags.resolved(empty, strings)[0]


def tag_resolve(spark, sf):
    return _tag_table(spark, sf).select("tag_id", "parent_tag_id", "slug", "depth", "path_cached")


def tag_rename(spark, sf):
    return tags.renamed(_tag_table(spark, sf), 1, "Renamed").select("tag_id", "name", "slug", "path_cached")


def tag_move(spark, sf):
    return tags.moved(_tag_table(spark, sf), 2, 1).select("tag_id", "parent_tag_id", "depth", "path_cached")


def tag_delete(spark, sf):
    held = _tag_table(spark, sf)
    links = _t(spark, sf, "part").select(F.col("p_partkey").alias("note_id"), F.lower(F.concat_ws("/", F.replace("p_type", F.lit(" "), F.lit("/")), "p_brand")).alias("path_cached"))
    links = links.join(held.select("tag_id", "path_cached"), "path_cached").select("note_id", "tag_id")
    left, notes, _ = tags.deleted(held, links, links.withColumnRenamed("note_id", "fragment_id"), 1)
    used = notes.groupBy("tag_id").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("tag_id", "_tag")
    return left.join(used, F.col("tag_id") == F.col("_tag"), "left").select("tag_id", "path_cached", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cards_rendered(spark, sf):
    o = _t(spark, sf, "orders")
    kind = F.element_at(F.array(*map(F.lit, ("heading", "qa", "cloze", "manual"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    held = o.select(F.col("o_orderkey").alias("card_id"), F.col("o_custkey").alias("note_id"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey")).alias("section_id"), kind.alias("card_type"),
                    F.when(F.col("o_orderkey") % 5 == 0, F.lit("front")).alias("custom_front"), F.when(F.col("o_orderkey") % 7 == 0, F.lit("back")).alias("custom_back"), F.col("o_orderstatus").alias("last_section_snapshot"))
    sections = o.select(F.col("o_orderkey").alias("section_id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("heading"), F.concat(F.lit("text of "), F.col("o_orderkey").cast("string")).alias("text_raw"))
    notes = _t(spark, sf, "customer").select(F.col("c_custkey").alias("note_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("path_cached"))
    return cards.rendered(held, sections, notes)


def chunk_candidates(spark, sf):
    """The three best notes (labels) for each chunk (every twentieth vector), by their ten best fragments."""
    e = _t(spark, sf, "embeddings")
    hits = vector.vector_search_batch(e, _query_vectors(spark, sf), 10).join(e.select("vec_id", "label"), "vec_id")
    rows = hits.select(F.col("query_id").alias("chunk_index"), F.col("label").alias("note_id"), F.round("similarity", 6).alias("score"))
    return distribute.candidate_notes(rows)


def decode_recommendations(spark, sf):
    o = _t(spark, sf, "orders")
    text = F.expr("""CASE o_orderkey % 6
        WHEN 0 THEN concat('{"action":"append","target_note_id":', o_custkey, ',"tags":["a","b"],"confidence":0.5,"reason":"r"}')
        WHEN 1 THEN concat('{"action":"create_child","parent_note_id":null,"new_note_title":"t', o_custkey, '","reason":"r"}')
        WHEN 2 THEN concat('{"action":"create_child","parent_chunk_index":', o_custkey, ',"new_note_title":"t","reason":"r"}')
        WHEN 3 THEN concat('{"action":"merge_with_chunk","merge_target_chunk_index":', o_custkey, '}')
        WHEN 4 THEN '{"action":"append","reason":"no target"}' ELSE 'no json' END""")
    rows = distribute.decoded(o.select(F.col("o_orderkey").alias("chunk_index"), text.alias("recommendation")))
    return rows.select("chunk_index", "action", "target_note_id", "parent_note_id", "new_note_title", "merge_into", F.array_join("tags", ",").alias("tags"), "confidence", "reason")


def fragment_notes(spark, sf):
    """The fragments of all documents by the standard preset."""
    rows = fragments.fragmented(_marked(spark, sf), key="doc_id", text="text")
    return rows.select("doc_id", "order_index", "title", tx.content_hash(F.col("raw_text")).alias("raw_hash"), tx.content_hash(F.col("clean_text")).alias("clean_hash"))


def stemmed_boost(spark, sf):
    boosted = fusion.term_boost(F.col("clean_text"), ["heating", "things", "networks"], stem=True)
    return _rounded(_docs(spark, sf).select("fragment_id", boosted.alias("boost")), "boost")


def calibration_run(spark, sf):
    hits, queries = _calibration_hits(spark, sf)
    return calibration.calibrated(hits, queries, calibration.grid(spark))[1]


def model_facts(spark, sf):
    kinds = ["BGE-small-en", "multilingual-e5-large", "Qwen3-Embedding-8B-Q4_K_M", "all-minilm-l6-v2", "text-embedding-3-large", "other-q8_0"]
    name = F.element_at(F.array(*map(F.lit, kinds)), (F.col("s_suppkey") % len(kinds) + 1).cast("int"))
    rows = _t(spark, sf, "supplier").select("s_suppkey", name.alias("model"))
    return rows.select("s_suppkey", nt.prefixed_query(F.lit("x"), F.col("model")).alias("asked"), nt.prefixed_passage(F.lit("x"), F.col("model")).alias("passage"), nt.known_dimension(F.col("model")).alias("dimension"), nt.quantization(F.col("model")).alias("quantization"))


def blob_round_trip(spark, sf):
    e = _t(spark, sf, "embeddings").select("vec_id", to_blob(F.col("embedding")).alias("blob"), "embedding")
    back = from_blob(F.col("blob"))
    return e.select("vec_id", F.octet_length("blob").cast("long").alias("n_bytes"), (back == F.col("embedding")).alias("same"))


def draft_titles(spark, sf):
    return _t(spark, sf, "orders").select("o_orderkey", nt.draft_title(F.col("o_orderdate")).alias("title"))


QUERIES = {f.__name__: f for f in (
    hybrid_search, kw_bm25_single, kw_bm25_and, kw_bm25_or_fallback, kw_match_counts, kw_posting_search, kw_posting_after_change,
    kw_posting_batch, hybrid_search_table, prefetched_hits, calibration_of_hits, fuzzy_titles, kw_snippets, vec_topk_dot, vec_topk_batch, vec_cosine_pairs,
    l2_norms, vec_dim_guard, semantic_merge_groups, best_per_group_top3, rrf_two_lists, rrf_weighted_k, term_boost, ratio_cutoff,
    min_score_filter, scoring_rerank, listwise_rerank, mrr_eval, grid_search_best, min_score_calibrated, token_counts, clean_markdown,
    collapse_blank_lines, strip_links, list_markers, heading_markers, latex_strip, fragment_lines, pack_char_budget, pack_token_budget,
    dedup_fragments, content_hash_dups, incremental_diff, needs_indexing, drift_stale, cache_hit_miss, cache_ttl, lang_mode, note_tree_paths,
    descendant_pairs, hierarchical_due_counts, repeat_mode_tree, visible_due_counts, active_repeat_tree, reschedule, merge_ends, due_queue, due_count, tag_closure_build, tag_autocomplete, tag_subtree_notes,
    tag_inherit_anti, tag_move_closure, hashtag_extract, json_payload, review_state_fold, plan_append_concat, heuristic_parent,
    plan_create_child_levels, fetch_page, streaming_index, streaming_reviews, streaming_index_applied, streaming_cache_expiry, active_search, index_apply, drift_apply, crash_recovery,
    fetch_joined, content_update, delete_cascade, tag_resolve, tag_rename, tag_move, tag_delete, cards_rendered, chunk_candidates,
    decode_recommendations, fragment_notes, stemmed_boost, calibration_run, model_facts, blob_round_trip, draft_titles)}

"""Applying a distribution plan: appended chunks, new children, merges, parents by title."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prompts import distribution, parsed_json
from ..tables import bounded, kept
from . import store
from .hierarchy import depths, roots
from .tags import associated, resolved


def appended(targets: DataFrame, chunks: DataFrame, draft_id: int | None = None, now: str | None = None) -> DataFrame:
    """``targets`` (note_id, content) with the texts of ``chunks`` (target_id, chunk_index, text) behind,
    in the order of chunks.

    With ``draft_id`` each text comes after a comment that names the draft and the time ``now``; an
    empty target gets the first text without one.
    """
    mark = "\n\n" if draft_id is None else f"\n\n<!-- imported from draft #{draft_id} on {now} -->\n"
    texts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda c: c["text"])
    added = chunks.groupBy(F.col("target_id").alias("_id")).agg(F.array_join(texts, mark).alias("_added"))
    joined = targets.join(added, F.col("note_id") == F.col("_id"))
    empty = F.coalesce("content", F.lit("")) == ""
    return joined.select("note_id", F.when(empty, F.col("_added")).otherwise(F.concat("content", F.lit(mark), "_added")).alias("content"))


def resolve_merges(plan: DataFrame) -> DataFrame:
    """``chunk_index`` and ``end`` of the chunks of a plan (``chunk_index``, ``merge_into``) that merge into
    another one of it: the chunk that the chain of merges ends in, null in or behind a circle."""
    known = plan.select(F.col("chunk_index").alias("_known"))
    edges = plan.select("chunk_index", "merge_into").join(bounded(known), F.col("merge_into") == F.col("_known"), "left")
    into = F.when(F.col("_known") != F.col("chunk_index"), F.col("_known"))
    edges = kept(edges.select(F.col("chunk_index").alias("id"), into.alias("parent_id")))
    ends = roots(edges).join(bounded(edges.where("parent_id IS NOT NULL").select("id")), "id")
    return ends.select(F.col("id").alias("chunk_index"), F.col("root").alias("end"))


def parents_by_title(chunks: DataFrame) -> DataFrame:
    """``chunk_index`` and ``parent_index``: the first chunk of the draft whose title is shorter (in
    bytes) and either a part of the title by words, or has a word of four bytes or more of which a
    word of the title is the start, or the other way round; null without one.

    Titles meet by keys, never all with all.  Of a key only the first chunk below each length matters: keys'
    chunks are brought down to one a length, and a running minimum over lengths answers for all titles at once,
    so the work follows the rows however many of them share a key.  A part with a word of four bytes meets
    by that word; one of short words only is looked up by its first word, distinct sets of words with each other.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("title"), r"\s+"), lambda w: w != ""))
    rows = chunks.select("draft_id", "chunk_index", F.octet_length("title").alias("n"), F.array_sort(words).alias("w"))
    # Kept, since it is read several times; equal titles of a draft are one row.
    titles = kept(rows.where("draft_id IS NOT NULL AND n IS NOT NULL").groupBy("draft_id", "n", "w").agg(F.min("chunk_index").alias("first")))
    starts = lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w)), lambda i: F.substr(w, F.lit(1), i))
    all_starts = lambda ws: F.array_distinct(F.flatten(F.transform(ws, starts)))
    long = F.filter("w", lambda w: F.octet_length(w) >= 4)
    short = F.size(long) == 0
    none, empty = F.lit(None).cast("long"), F.size("w") == 0

    # what parents are found by, and what titles look for: long words by starts, starts of long words, no words
    by = lambda rows, kind, keys, first: rows.select("draft_id", "n", F.lit(kind).alias("kind"), F.explode(keys).alias("key"), first.cast("long").alias("first"))
    nothing, own = F.array(F.lit("")), F.col("first")
    ends = [by(titles, 0, long, own), by(titles, 1, all_starts(long), own), by(titles.where(empty), 2, nothing, own)]
    asks = [by(titles, 0, all_starts(F.col("w")), none), by(titles, 1, F.col("w"), none), by(titles, 2, nothing, none)]
    lengths = reduce(DataFrame.unionByName, ends + asks).groupBy("draft_id", "kind", "key", "n").agg(F.min("first").alias("first"))
    below = Window.partitionBy("draft_id", "kind", "key").orderBy("n").rangeBetween(Window.unboundedPreceding, -1)
    before = kept(lengths.select("draft_id", "kind", "key", "n", F.min("first").over(below).alias("parent")).where("parent IS NOT NULL"))
    named = lambda kind, keys: F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    keys = F.concat(named(0, all_starts(F.col("w"))), named(1, F.col("w")), named(2, nothing))
    asked = titles.select("draft_id", "n", "w", F.explode(keys).alias("k")).select("draft_id", "n", "w", "k.kind", "k.key")
    found = asked.join(before, ["draft_id", "kind", "key", "n"]).select("draft_id", "n", "w", "parent")

    sets = titles.groupBy("draft_id", "w").agg(F.array_sort(F.collect_list(F.struct("n", "first"))).alias("ns"))
    parts = titles.where(short & ~empty).groupBy("draft_id", "w").agg(F.collect_list(F.struct("n", "first")).alias("parts"))
    parts = parts.select(F.col("draft_id").alias("_draft"), F.col("w").alias("_w"), "parts")
    inside = sets.withColumn("_key", F.explode("w")).join(parts, (F.col("draft_id") == F.col("_draft")) & (F.col("_key") == F.col("_w")[0]))
    inside = inside.where(F.size(F.array_except("_w", "w")) == 0).select("draft_id", "w", "parts", F.explode("ns.n").alias("n"))
    least = F.array_min(F.transform(F.filter("parts", lambda x: x["n"] < F.col("n")), lambda x: x["first"]))
    found = found.unionByName(inside.select("draft_id", "n", "w", least.cast("long").alias("parent")))
    kind = chunks.schema["chunk_index"].dataType
    first = kept(found.groupBy("draft_id", "n", "w").agg(F.min("parent").cast(kind).alias("parent_index")).where("parent_index IS NOT NULL"))
    return rows.join(first, ["draft_id", "n", "w"], "left").select("draft_id", "chunk_index", "parent_index")


def creation_levels(plan: DataFrame) -> DataFrame:
    """``chunk_index``, ``level``: rounds in which children are made; those in or below a cycle, or whose
    parent isn't in the plan, go to the root."""
    rows = plan.select("chunk_index", "parent_index")
    made = depths(rows.select(F.col("chunk_index").alias("id"), F.col("parent_index").alias("parent_id")))
    joined = rows.select("chunk_index").join(bounded(made.withColumnRenamed("id", "chunk_index")), "chunk_index", "left")
    return joined.select("chunk_index", F.coalesce("depth", F.lit(0)).cast("long").alias("level"))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


#: What a recommendation may say; every field but the action may be missing.
RECOMMENDATION = ("action string, target_note_id long, target_section_id long, parent_note_id long, parent_chunk_index long, new_note_title string, "
                  "chunk_index long, merge_target_chunk_index long, tags array<string>, confidence double, reason string")  # fmt: skip


def decoded(answers: DataFrame, column: str = "recommendation") -> DataFrame:
    """``answers`` with a recommendation's fields in place of its JSON text.

    An action without what it needs, an unknown one and a broken text are ``skip``.  A parent chunk
    is the negative number of its place, -1 for the first; the target of a merge may have either name.
    """
    x = F.from_json(column, RECOMMENDATION)
    rows = answers.withColumn("_x", x)
    target = F.coalesce("_x.chunk_index", "_x.merge_target_chunk_index")
    complete = (
        ((F.col("_x.action") == "append") & F.col("_x.target_note_id").isNotNull())
        | ((F.col("_x.action") == "create_child") & F.col("_x.new_note_title").isNotNull())
        | ((F.col("_x.action") == "merge_with_chunk") & target.isNotNull())
    )
    action = F.when(F.coalesce(complete, F.lit(False)), F.col("_x.action")).otherwise("skip")
    rows = rows.withColumn("action", action)
    only = lambda kind, value: F.when(F.col("action") == kind, value)
    return rows.select(
        *[c for c in answers.columns if c != column],
        "action",
        only("append", F.col("_x.target_note_id")).alias("target_note_id"),
        only("create_child", F.coalesce("_x.parent_note_id", -F.col("_x.parent_chunk_index") - 1)).alias("parent_note_id"),
        only("create_child", F.col("_x.new_note_title")).alias("new_note_title"),
        only("merge_with_chunk", target).alias("merge_into"),
        F.col("_x.tags").alias("tags"),
        F.col("_x.confidence").alias("confidence"),
        F.coalesce("_x.reason", F.lit("")).alias("reason"),
    )


def candidate_notes(hits: DataFrame, most: int = 3, within: str = "chunk_index") -> DataFrame:
    """The best notes of each chunk: ``hits`` (``within``, ``note_id``, ``score``) by their note's best score."""
    best = hits.groupBy(within, "note_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy(within).orderBy(F.desc("score"), "note_id"))
    return best.withColumn("place", place).where(F.col("place") <= most)


def analyzed(chunks: DataFrame, candidates: DataFrame, titles: DataFrame, model) -> DataFrame:
    """The recommendation for each chunk of a draft (``chunk_index``, ``text``): one prompt with all chunks'
    whole texts and their candidates (``chunk_index``, ``note_id``) by id and title; missing answers are ``skip``.

    Drafts are asked for on the workers, ``draft_id`` by ``draft_id`` where chunks have one: a prompt is as
    large as its draft, which is what a model gets at once.
    """
    named = candidates.join(titles.select("note_id", "title"), "note_id").groupBy("chunk_index").agg(F.array_sort(F.collect_list(F.struct("note_id", "title"))).alias("notes"))
    draft = F.col("draft_id") if "draft_id" in chunks.columns else F.lit(0)
    rows = chunks.join(named, "chunk_index", "left").select(draft.alias("_draft"), "chunk_index", "text", "notes")
    drafts = rows.groupBy("_draft").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text", "notes"))).alias("chunks"))

    @F.pandas_udf("array<string>")
    def ask(batch: pd.Series) -> pd.Series:
        def one(own):
            held = [(c["chunk_index"], c["text"] or "", [(n["note_id"], n["title"]) for n in (c["notes"] if c["notes"] is not None else [])]) for c in own]
            answers = parsed_json(model(distribution(held)), list)
            return [json.dumps(answers[i]) if i < len(answers) else None for i in range(len(held))]

        return batch.map(one)

    answered = drafts.select(F.explode(F.arrays_zip(F.col("chunks.chunk_index"), ask("chunks").alias("answer"))).alias("x"))
    found = kept(answered.select(F.col("x.chunk_index").alias("chunk_index"), F.col("x.answer").alias("recommendation")))
    return chunks.join(decoded(found), "chunk_index")


def audited(runs: DataFrame, plan: DataFrame, draft_id: int, now: int, version: str = "v1") -> DataFrame:
    """``distribution_runs`` with a row for an analysis: the draft and its whole plan as JSON."""
    chunks = F.array_sort(F.collect_list(F.struct("chunk_index", F.struct(*[c for c in plan.columns if c != "chunk_index"]).alias("plan"))))
    row = plan.agg(F.to_json(F.struct(F.lit(draft_id).alias("draft_id"), chunks.alias("chunks"))).alias("plan_json"))  # one draft
    new = row.select(F.lit(draft_id).cast("long").alias("draft_id"), "plan_json", F.lit(version).alias("generator_version"), F.lit("analyzed").alias("status"), F.lit(now).cast("long").alias("created_at"))
    return runs.unionByName(store.with_ids(new, runs, "run_id", "draft_id"), allowMissingColumns=True)


def audit_applied(runs: DataFrame, draft_id: int, result: str, now: int) -> DataFrame:
    """``distribution_runs`` after the last analysis of a draft was applied, with its result."""
    last = runs.where((F.col("draft_id") == draft_id) & (F.col("status") == "analyzed")).agg(F.max("run_id").alias("_last"))
    marked = runs.join(F.broadcast(last), F.col("run_id") == F.col("_last"), "left")  # one row
    hit = F.col("_last").isNotNull()
    changes = {"status": F.lit("applied"), "result_json": F.lit(result), "applied_at": F.lit(now).cast("long")}
    return marked.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()}).drop("_last")


def merged(plan: DataFrame) -> DataFrame:
    """``plan`` (``chunk_index``, ``text``, ``action``, ``merge_into``, ...) of a draft with the texts of merged
    chunks, in their order, behind those of the chunks they end in; merges into nothing and in circles skip."""
    rows = kept(plan)
    ends = kept(resolve_merges(rows))
    texts = rows.select("chunk_index", F.coalesce("text", F.lit("")).alias("text")).join(ends, "chunk_index", "left_anti").select(F.col("chunk_index").alias("_chunk"), F.lit(0).alias("_part"), "chunk_index", "text")
    added = rows.join(ends.where("end IS NOT NULL"), "chunk_index").select(F.col("end").alias("_chunk"), F.lit(1).alias("_part"), "chunk_index", F.coalesce("text", F.lit("")).alias("text"))
    parts = texts.unionByName(added).where("text <> ''").groupBy("_chunk").agg(F.array_sort(F.collect_list(F.struct("_part", "chunk_index", "text"))).alias("_parts"))
    joined = parts.select("_chunk", F.array_join(F.transform("_parts", lambda x: x["text"]), "\n\n").alias("_text"))
    out = rows.join(joined, F.col("chunk_index") == F.col("_chunk"), "left")
    skips = F.col("action") == "merge_with_chunk"
    out = out.withColumn("reason", F.when(skips, "Merged into another chunk").otherwise(F.col("reason")))
    return out.withColumn("text", F.coalesce("_text", F.lit(""))).withColumn("action", F.when(skips, "skip").otherwise(F.col("action"))).drop("_chunk", "_text", "merge_into")


def applied(tables: dict[str, DataFrame], plan: DataFrame, draft_id: int, now: int, stamp: str) -> dict[str, DataFrame]:
    """``notes``, ``note_revisions``, ``tags``, ``note_tags`` after a plan: merges, then texts appended to
    their notes, then children made level by level below notes or below other children (below the
    root where parents form a circle), all of them pending and tagged.  The draft is archived unless
    the plan as it was given skips a chunk."""
    skipped = not plan.where("action = 'skip'").isEmpty()
    rows = kept(merged(plan))
    notes, revisions = tables["notes"], tables["note_revisions"]
    adding = rows.where("action = 'append'")
    texts = adding.select(F.col("target_note_id").alias("target_id"), "chunk_index", "text")
    contents = kept(appended(notes.select("note_id", "content"), texts, draft_id, stamp))
    notes, revisions = store.with_content(notes, revisions, contents, now)
    notes = store.with_status(notes, contents.select("note_id"), "pending")

    making = rows.where("action = 'create_child'")
    inside = making.select("chunk_index", F.when(F.col("parent_note_id") < 0, (-F.col("parent_note_id") - 1).cast("long")).alias("parent_index"))
    known = inside.select(F.col("chunk_index").alias("_known"))
    lost = F.col("parent_index").isNotNull() & F.col("_known").isNull()
    inside = inside.join(known, F.col("parent_index") == F.col("_known"), "left").withColumn("parent_index", F.when(~lost, F.col("parent_index"))).drop("_known")
    levels = kept(creation_levels(inside))
    made = None
    for level in range((levels.agg(F.max("level")).first()[0] or 0) + 1):
        of = making.join(levels.where(F.col("level") == level).select("chunk_index"), "chunk_index")
        parent = F.when(F.col("parent_note_id") >= 0, F.col("parent_note_id"))
        if made is not None:
            ids = made.select((-F.col("chunk_index") - 1).alias("_temp"), F.col("note_id").alias("_id"))
            of = of.join(ids, F.col("parent_note_id") == F.col("_temp"), "left")
            parent = F.coalesce(F.col("_id"), parent)
        new = of.select("chunk_index", F.col("new_note_title").alias("title"), F.col("text").alias("content"), parent.cast("long").alias("parent_note_id"))
        before = notes
        notes = kept(store.inserted_notes(before, new.drop("chunk_index"), now))
        added = notes.join(before.select("note_id"), "note_id", "left_anti").select("note_id", "title", "content")
        named = kept(new.select("chunk_index", "title", "content").join(added, ["title", "content"]).groupBy("chunk_index").agg(F.min("note_id").alias("note_id")))
        made = named if made is None else made.unionByName(named)

    ids = adding.select("chunk_index", F.col("target_note_id").alias("note_id"))
    ids = ids if made is None else ids.unionByName(made)
    tagged = kept(ids.join(rows.select("chunk_index", F.explode("tags").alias("path"), "confidence"), "chunk_index").withColumn("path", F.lower(F.btrim(F.ltrim("path", F.lit("#"))))))
    tags, found = resolved(tables["tags"], tagged.select("path"))
    links = tagged.join(found, "path").select("note_id", "tag_id", F.lit(None).cast("double").alias("confidence"))
    note_tags = associated(tables["note_tags"], links, "ai", now)
    if not skipped:
        draft = rows.sparkSession.createDataFrame([(draft_id,)], "note_id long")
        notes = store.with_lifecycle(notes, draft, "archived", now)
    return tables | {"notes": notes, "note_revisions": revisions, "tags": tags, "note_tags": note_tags}

"""Notes, fragments and their vectors as tables: reads, and rewrites that yield the table after them.

Every function takes DataFrames with the columns of ``schemas.SCHEMAS`` and returns DataFrames; what
is written where is the caller's choice.  Sets of ids are DataFrames too, so a rewrite is one join
however many rows it concerns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import defaults as d
from ..functions.notes import revision
from ..functions.text import content_hash
from ..tables import kept, numbered
from .hierarchy import below
from .indexing import deduplicated, drifted, fragment_changes, replaced

VERSION = "1"

#: Conditions on a note's lifecycle.
ACTIVE = "lifecycle = 'active'"
NOT_DELETED = "lifecycle <> 'deleted'"
VISIBLE_IN_TREE = "lifecycle NOT IN ('deleted', 'draft')"
DISTRIBUTABLE = "lifecycle = 'draft'"


def _among(rows: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    return rows.join(ids.select(F.col(ids.columns[0]).alias("_id")), F.col(key) == F.col("_id"), how)


def _rewritten(rows: DataFrame, ids: DataFrame, key: str, changes: dict[str, Column]) -> DataFrame:
    """``rows`` with ``changes`` for those whose key is in ``ids``."""
    marked = rows.join(ids.select(F.col(ids.columns[0]).alias("_id")).distinct(), F.col(key) == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    return marked.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()}).drop("_id")


def lifecycle_of_flags(deleted: Column, archived: Column, draft: Column) -> Column:
    """The lifecycle that old flags stand for."""
    return F.when(deleted, "deleted").when(archived, "archived").when(draft, "draft").otherwise("active")


# Reads


def note_list(notes: DataFrame) -> DataFrame:
    """What lists show of all notes, whatever their lifecycle."""
    return notes.select("note_id", "title", "parent_note_id", "indexing_status", "lifecycle")


def point(rows: DataFrame, key: str, value) -> DataFrame:
    """The row with a key; a null value finds the rows without one."""
    return rows.where(F.col(key).eqNullSafe(F.lit(value)))


def children(rows: DataFrame, parent: str, value) -> DataFrame:
    """Rows under a parent, the roots for a null value."""
    return point(rows, parent, value)


def searchable(fragments: DataFrame, notes: DataFrame) -> DataFrame:
    """Fragments of active notes."""
    return _among(fragments, notes.where(ACTIVE).select("note_id"), "note_id")


def with_vectors(fragments: DataFrame, embeddings: DataFrame, model: str, version: str = VERSION) -> DataFrame:
    """All ``fragments`` with the ``embedding`` of one model and version, null without one."""
    of_model = embeddings.where((F.col("embedding_model") == model) & (F.col("embedding_model_version") == version))
    held = of_model.select(F.col("fragment_id").alias("_fragment"), "embedding")
    return fragments.join(held, F.col("fragment_id") == F.col("_fragment"), "left").drop("_fragment")


def note_fragments(fragments: DataFrame, embeddings: DataFrame, note_id: int, model: str) -> DataFrame:
    return with_vectors(point(fragments, "note_id", note_id), embeddings, model).orderBy("order_index")


def fetch(fragments: DataFrame, notes: DataFrame, embeddings: DataFrame, model: str, note_id: int | None = None,
          include_deleted: bool = False, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Fragments with their note's title and path and their vector, by note and position, a page of them.
    The filters remove rows."""
    notes = notes if include_deleted else notes.where(NOT_DELETED)
    notes = notes if note_id is None else point(notes, "note_id", note_id)
    named = notes.select(F.col("note_id").alias("_note"), F.col("title").alias("note_title"), F.col("path_cached").alias("note_path"))
    rows = with_vectors(fragments.join(named, F.col("note_id") == F.col("_note")).drop("_note"), embeddings, model)
    rows = rows.orderBy("note_id", "order_index").offset(offset)
    return rows if limit is None else rows.limit(limit)


def sample_texts(fragments: DataFrame, limit: int = d.LANGUAGE_SAMPLE) -> DataFrame:
    """The first texts that aren't empty."""
    return fragments.where("clean_text <> ''").orderBy("fragment_id").limit(limit).select("clean_text")


def as_sections(fragments: DataFrame) -> DataFrame:
    """Fragments as sections: no heading, no offsets."""
    return fragments.select(F.col("fragment_id").alias("section_id"), "note_id", F.lit(None).cast("string").alias("heading"), F.lit(0).alias("begin"), F.lit(0).alias("end"), F.col("raw_text").alias("text_raw"))


def fragment_counts(fragments: DataFrame) -> DataFrame:
    return fragments.groupBy("note_id").agg(F.count(F.lit(1)).alias("n_fragments"))


def hydrated(hits: DataFrame, fragments: DataFrame, notes: DataFrame) -> DataFrame:
    """Hits (``fragment_id``, ...) with text, position and note: joined after the cut, so that only hits
    are looked up."""
    texts = fragments.select(F.col("fragment_id").alias("_fragment"), F.col("note_id"), F.col("order_index").alias("fragment_index"), "raw_text", "clean_text")
    titles = notes.select(F.col("note_id").alias("_note"), F.col("title").alias("note_title"), F.col("path_cached").alias("note_path"))
    found = texts.join(F.broadcast(hits), F.col("fragment_id") == F.col("_fragment")).drop("_fragment")
    return titles.join(F.broadcast(found), F.col("note_id") == F.col("_note")).drop("_note")


# Key-value


def get_value(meta: DataFrame, key: str) -> str | None:
    row = meta.where(F.col("key") == key).select("value").first()
    return None if row is None else row[0]


def get_float(meta: DataFrame, key: str) -> float | None:
    """The number at a key; None where there is none or it isn't one."""
    row = meta.where(F.col("key") == key).select(F.expr("try_cast(value AS double)")).first()
    return None if row is None else row[0]


def set_values(meta: DataFrame, values: dict[str, str]) -> DataFrame:
    new = meta.sparkSession.createDataFrame(list(values.items()), "key string, value string")
    return replaced(meta, new, ["key"])


def put_absent(cache: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``cache`` and those of ``rows`` whose key it doesn't have; of equal keys one."""
    return cache.unionByName(rows.dropDuplicates(keys).join(cache.select(*keys), keys, "left_anti"))


# Notes


def _next_id(rows: DataFrame, key: str) -> int:
    return (rows.agg(F.max(key)).first()[0] or 0) + 1


def with_ids(new: DataFrame, existing: DataFrame, key: str, *order) -> DataFrame:
    """``new`` with ids that follow the largest of ``existing``, in ``order``, without one task for all."""
    start = _next_id(existing, key)
    return numbered(new, *order, name=key).withColumn(key, F.col(key) + F.lit(start))


def inserted_notes(notes: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """``notes`` and the rows of ``new`` (``title``, ``content``, ``parent_note_id``): pending, with hash
    and path (the parent's path and the title)."""
    parents = notes.select(F.col("note_id").alias("_parent"), F.col("path_cached").alias("_path"))
    rows = new.join(parents, F.col("parent_note_id") == F.col("_parent"), "left").select(
        "title", "content", "parent_note_id", content_hash(F.col("content")).alias("content_hash"), F.concat_ws("/", "_path", "title").alias("path_cached"),
        F.lit("pending").alias("indexing_status"), F.lit("active").alias("lifecycle"), F.lit(now).cast("long").alias("created_at"), F.lit(now).cast("long").alias("updated_at"),
    )
    return notes.unionByName(with_ids(rows, notes, "note_id", "path_cached", "content_hash"), allowMissingColumns=True)


def with_status(notes: DataFrame, ids: DataFrame, status: str, error: str | None = None) -> DataFrame:
    """Sets the indexing status; a failure comes with its error."""
    changes = {"indexing_status": F.lit(status)}
    return _rewritten(notes, ids, "note_id", changes if error is None else changes | {"indexing_error": F.lit(error)})


def with_lifecycle(notes: DataFrame, ids: DataFrame, lifecycle: str, now: int) -> DataFrame:
    """Soft delete, restore (``active``) and archive."""
    return _rewritten(notes, ids, "note_id", {"lifecycle": F.lit(lifecycle), "updated_at": F.lit(now).cast("long")})


def with_content(notes: DataFrame, revisions: DataFrame, new: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Notes and revisions after new contents (``note_id``, ``content``): a changed note becomes stale,
    and its difference a revision; equal contents change nothing."""
    wanted = new.select(F.col("note_id").alias("_note"), F.col("content").alias("_content"))
    joined = notes.join(wanted, F.col("note_id") == F.col("_note"), "left")
    changed = F.col("_note").isNotNull() & ~F.col("content").eqNullSafe(F.col("_content"))
    values = {"content": F.col("_content"), "content_hash": content_hash(F.col("_content")), "indexing_status": F.lit("stale"), "updated_at": F.lit(now).cast("long")}
    rewritten = joined.withColumn("_changed", changed)
    after = rewritten.select(*[F.when(F.col("_changed"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in notes.columns])
    patches = rewritten.where("_changed").select("note_id", revision(F.col("content"), F.col("_content")).alias("patch"), F.lit(now).cast("long").alias("created_at"))
    return after, revisions.unionByName(with_ids(kept(patches), revisions, "revision_id", "note_id"))


def paths_rewritten(rows: DataFrame, key: str, parent: str, changed: int, name: str | None = None, new_parent: int | None = None,
                    moved: bool = False, path: str = "path_cached", title: str = "title") -> DataFrame:
    """``rows`` of a tree with paths after one was renamed (``name``) or moved (``moved``, ``new_parent``;
    null: to the roots): its path and those of all below it follow.  Moving it below itself is an error."""
    node = rows.where(F.col(key) == changed).first()
    if node is None:
        raise ValueError(f"no row {changed}")
    subtree = kept(below(rows, key, parent, changed).select(F.col("id").alias("_at")))
    above = new_parent if moved else node[parent]
    if moved and above is not None and not subtree.where(F.col("_at") == above).isEmpty():
        raise ValueError("a row can't move below itself")
    found = None if above is None else rows.where(F.col(key) == above).select(path).first()
    own = name or node[title]
    new_path = own if found is None else f"{found[0]}/{own}"
    hit = F.col("_at").isNotNull()
    cut = F.substr(path, F.lit(len(node[path]) + 1))
    marked = rows.join(subtree, F.col(key) == F.col("_at"), "left")
    changes = {path: F.when(hit, F.concat(F.lit(new_path), cut)).otherwise(F.col(path))}
    own_row = F.col(key) == changed
    if name is not None:
        changes[title] = F.when(own_row, F.lit(name)).otherwise(F.col(title))
    if moved:
        changes[parent] = F.when(own_row, F.lit(new_parent).cast("long")).otherwise(F.col(parent))
    return marked.withColumns(changes).drop("_at")


# Fragments and vectors


def inserted_fragments(fragments: DataFrame, new: DataFrame) -> DataFrame:
    """``fragments`` and those of ``new`` whose text its note doesn't have yet; of equal texts the first."""
    fresh = deduplicated(new.withColumn("hash", F.col("clean_text_hash"))).drop("hash")
    keys = ["note_id", "clean_text_hash"]
    fresh = fresh.join(fragments.select(*keys), keys, "left_anti")
    return fragments.unionByName(with_ids(fresh, fragments, "fragment_id", "note_id", "order_index"), allowMissingColumns=True)


def fragment_id_of(fragments: DataFrame, note_id: int, clean_text_hash: str) -> int | None:
    """The fragment of a note with a text: what inserting it again yields."""
    row = fragments.where((F.col("note_id") == note_id) & (F.col("clean_text_hash") == clean_text_hash)).select("fragment_id").first()
    return None if row is None else row[0]


def with_embeddings(embeddings: DataFrame, fragments: DataFrame, new: DataFrame) -> DataFrame:
    """``embeddings`` with those of ``new`` (``note_id``, ``order_index``, and the vector's columns) in
    place of what their fragments had of that model and version."""
    at = new.join(fragments.select("fragment_id", "note_id", "order_index"), ["note_id", "order_index"]).select(*embeddings.columns)
    return replaced(embeddings, at, ["fragment_id", "embedding_model", "embedding_model_version"])


def updated_fragments(fragments: DataFrame, embeddings: DataFrame, new: DataFrame, now: int, invalidate: bool = True) -> tuple[DataFrame, DataFrame]:
    """Fragments with the texts of ``new`` (``note_id``, ``order_index``, ``raw_text``, ``clean_text``) in their
    places, and the vectors, without theirs if they are to be made again."""
    keys = ["note_id", "order_index"]
    texts = new.select(*keys, "raw_text", "clean_text", content_hash(F.col("raw_text")).alias("raw_text_hash"), content_hash(F.col("clean_text")).alias("clean_text_hash"))
    held = fragments.select("fragment_id", *keys, "created_at").join(texts, keys).withColumn("updated_at", F.lit(now).cast("long"))
    changed = kept(held.select(*fragments.columns))
    after = replaced(fragments, changed, ["fragment_id"])
    return after, _among(embeddings, changed.select("fragment_id"), "fragment_id", "left_anti") if invalidate else embeddings


def deleted_fragments(fragments: DataFrame, embeddings: DataFrame, cards: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables without the fragments in ``ids``: vectors go with them, cards become orphans that
    keep the text."""
    gone = _among(fragments, ids, "fragment_id").select(F.col("fragment_id").alias("_gone"), F.col("raw_text").alias("_text"))
    marked = cards.join(gone, F.col("section_id") == F.col("_gone"), "left")
    hit = F.col("_gone").isNotNull()
    orphaned = marked.withColumn("status", F.when(hit, "orphaned").otherwise(F.col("status")))
    orphaned = orphaned.withColumn("last_section_snapshot", F.when(hit, F.col("_text")).otherwise(F.col("last_section_snapshot"))).drop("_gone", "_text")
    return _among(fragments, ids, "fragment_id", "left_anti"), _among(embeddings, ids, "fragment_id", "left_anti"), orphaned


def deleted_cards(cards: DataFrame, schedules: DataFrame, logs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables without the cards in ``ids``, their schedules and the logs of these."""
    return (_among(cards, ids, "card_id", "left_anti"), *_without_targets(schedules, logs, "card", ids))


def _without_targets(schedules: DataFrame, logs: DataFrame, kind: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    of = _among(schedules.where(F.col("target_type") == kind), ids, "target_id").select("schedule_id")
    return _among(schedules, of, "schedule_id", "left_anti"), _among(logs, of, "schedule_id", "left_anti")


def deleted_notes(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """``notes``, ``fragments``, ``fragment_embeddings``, ``cards``, ``schedules``, ``review_logs`` without
    the notes in ``ids`` and all that hangs on them; children of theirs become roots."""
    ids = kept(ids.select(F.col(ids.columns[0]).alias("note_id")).distinct())
    out = dict(tables)
    left = _among(tables["notes"], ids, "note_id", "left_anti")
    out["notes"] = _rewritten(left, ids, "parent_note_id", {"parent_note_id": F.lit(None).cast("long")})
    of_notes = _among(tables["fragments"], ids, "note_id").select("fragment_id")
    out["fragments"], out["fragment_embeddings"], cards = deleted_fragments(tables["fragments"], tables["fragment_embeddings"], tables["cards"], of_notes)
    gone = _among(tables["cards"], ids, "note_id").select("card_id")
    out["cards"], schedules, logs = deleted_cards(cards, tables["schedules"], tables["review_logs"], gone)
    out["schedules"], out["review_logs"] = _without_targets(schedules, logs, "note", ids)
    return out


# Indexing


def indexed(notes: DataFrame, fragments: DataFrame, embeddings: DataFrame, new: DataFrame, ids: DataFrame, model: str, dimension: int,
            now: int, version: str = VERSION) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Notes, fragments and vectors after the notes in ``ids`` were cut into ``new`` (``note_id``,
    ``order_index``, ``raw_text``, ``clean_text``).

    Position by position a fragment stays, takes the new text and loses its vector, comes anew or
    goes; the notes become indexed.  Running it again changes nothing but the time.
    """
    ids = kept(ids.select(F.col(ids.columns[0]).alias("note_id")).distinct())
    texts = new.select("note_id", F.col("order_index").cast("long").alias("order_index"), "raw_text", "clean_text", content_hash(F.col("raw_text")).alias("raw_text_hash"), content_hash(F.col("clean_text")).alias("clean_text_hash"))
    texts = kept(_among(texts, ids, "note_id"))
    old = _among(fragments, ids, "note_id")
    changes = fragment_changes(old.withColumn("hash", F.col("clean_text_hash")), texts.withColumn("hash", F.col("clean_text_hash")))
    changes = kept(changes.select("note_id", "order_index", "change"))
    keys = ["note_id", "order_index"]
    touched = lambda kind: changes.where(F.col("change") == kind).select(*keys)
    same = old.join(touched("same"), keys, "left_semi").select(*fragments.columns)
    stamp = lambda rows: rows.withColumn("updated_at", F.lit(now).cast("long"))
    updated = old.join(touched("update"), keys, "left_semi").select("fragment_id", *keys, "created_at")
    updated = stamp(updated.join(texts, keys)).select(*fragments.columns)
    fresh = stamp(texts.join(touched("insert"), keys, "left_semi").withColumn("created_at", F.lit(now).cast("long")))
    fresh = with_ids(fresh, fragments, "fragment_id", *keys).select(*fragments.columns)
    others = _among(fragments, ids, "note_id", "left_anti")
    after = reduce(DataFrame.unionByName, [others, same, updated, fresh])
    stale = old.join(touched("update").unionByName(touched("delete")), keys, "left_semi").select("fragment_id")
    values = {"indexing_status": F.lit("indexed"), "indexing_error": F.lit(None).cast("string"), "indexed_at": F.lit(now).cast("long"),
              "embedding_model": F.lit(model), "embedding_dimension": F.lit(dimension), "indexing_version": F.lit(version)}
    return _rewritten(notes, ids, "note_id", values), after, _among(embeddings, stale, "fragment_id", "left_anti")


def marked_for_model(notes: DataFrame, fragments: DataFrame, embeddings: DataFrame, model: str, dimension: int) -> tuple[DataFrame, DataFrame]:
    """Notes and vectors after a change of model: notes indexed with another one become pending and
    lose their vectors."""
    stale = kept(notes.where(drifted(model, dimension)).select("note_id"))
    gone = _among(fragments, stale, "note_id").select("fragment_id")
    after = _rewritten(notes, stale, "note_id", {"indexing_status": F.lit("pending"), "indexed_at": F.lit(None).cast("long")})
    return after, _among(embeddings, gone, "fragment_id", "left_anti")


def recovered(notes: DataFrame, fragments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """After a crash: notes that were being indexed have failed, and lose their fragments."""
    broken = kept(notes.where("indexing_status = 'indexing'").select("note_id"))
    return with_status(notes, broken, "failed", "Interrupted indexing"), _among(fragments, broken, "note_id", "left_anti")


def to_index(notes: DataFrame, needs: Column, force: bool = False) -> DataFrame:
    """Ids of the notes that a run of the indexer takes: those that need it, or all that aren't deleted."""
    return notes.where(NOT_DELETED if force else needs).select("note_id")

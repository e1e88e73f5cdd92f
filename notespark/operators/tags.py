"""Tags: making them from strings, moving, renaming and deleting them, and their links to notes.

``tags`` has ``tag_id``, ``parent_tag_id``, ``name``, ``slug``, ``depth``, ``path_cached``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import kept
from .hierarchy import below, closure, inherited, tags_of_strings, tree_paths
from .indexing import replaced
from .store import _among, paths_rewritten, with_ids


def resolved(tags: DataFrame, strings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``tags`` with all missing levels of the tag strings (``path``, with slashes), and the ids of the
    strings' last levels (``path``, ``tag_id``)."""
    levels = kept(tags_of_strings(strings))
    missing = levels.join(tags.select(F.col("path_cached").alias("path")), "path", "left_anti")
    rows = missing.select("path", "parent_path", "name", F.col("name").alias("slug"), F.col("depth").cast("int").alias("depth"), F.col("path").alias("path_cached"))
    new = kept(with_ids(rows, tags, "tag_id", "depth", "path"))
    ids = tags.select("tag_id", "path_cached").unionByName(new.select("tag_id", "path_cached"))
    above = ids.select(F.col("path_cached").alias("_above"), F.col("tag_id").alias("parent_tag_id"))
    new = new.join(above, F.col("parent_path") == F.col("_above"), "left").drop("_above", "path", "parent_path")
    leaves = strings.select(F.lower(F.btrim("path")).alias("path")).distinct()
    found = leaves.join(ids, F.col("path") == F.col("path_cached")).select("path", "tag_id")
    return tags.unionByName(new, allowMissingColumns=True), found


def closed(tags: DataFrame) -> DataFrame:
    """The closure table of ``tags``."""
    return closure(tree_paths(tags.select(F.col("tag_id").alias("id"), F.col("parent_tag_id").alias("parent_id"), F.col("slug").alias("name"))))


def moved(tags: DataFrame, tag_id: int, parent_id: int | None) -> DataFrame:
    """``tags`` after one moved under another one (null: to the roots), with the paths and depths below."""
    return _with_depths(paths_rewritten(tags, "tag_id", "parent_tag_id", tag_id, new_parent=parent_id, moved=True, title="slug"))


def renamed(tags: DataFrame, tag_id: int, name: str) -> DataFrame:
    """``tags`` after one was renamed, with the paths below."""
    slug = name.strip().lower()
    after = paths_rewritten(tags, "tag_id", "parent_tag_id", tag_id, name=slug, title="slug")
    return after.withColumn("name", F.when(F.col("tag_id") == tag_id, F.lit(name)).otherwise(F.col("name")))


def _with_depths(tags: DataFrame) -> DataFrame:
    return tags.withColumn("depth", F.size(F.split("path_cached", "/")) - 1)


def deleted(tags: DataFrame, note_tags: DataFrame, fragment_tags: DataFrame, tag_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables without a tag and those below it, and without their links."""
    gone = kept(below(tags, "tag_id", "parent_tag_id", tag_id))
    return tuple(_among(rows, gone, "tag_id", "left_anti") for rows in (tags, note_tags, fragment_tags))


def associated(note_tags: DataFrame, links: DataFrame, source: str, now: int) -> DataFrame:
    """``note_tags`` with ``links`` (``note_id``, ``tag_id``, ``confidence``), in place of what they had."""
    new = links.select("note_id", "tag_id", F.lit(source).alias("source"), F.col("confidence").cast("double").alias("confidence"), F.lit(now).cast("long").alias("created_at"))
    return replaced(note_tags, new.dropDuplicates(["note_id", "tag_id"]), ["note_id", "tag_id"])


def dissociated(note_tags: DataFrame, links: DataFrame) -> DataFrame:
    return note_tags.join(links.select("note_id", "tag_id"), ["note_id", "tag_id"], "left_anti")


def tags_of_notes(note_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """``note_tags`` with name and path of the tags."""
    return note_tags.join(tags.select("tag_id", "name", "path_cached"), "tag_id")


def with_inherited(note_tags: DataFrame, fragments: DataFrame, fragment_tags: DataFrame, now: int) -> DataFrame:
    """``fragment_tags`` with what fragments inherit from their notes and don't have yet."""
    new = inherited(note_tags, fragments, fragment_tags)
    return fragment_tags.unionByName(new.withColumn("source", F.lit("inherited")).withColumn("created_at", F.lit(now).cast("long")))


def without_inherited(links: DataFrame, fragments: DataFrame, fragment_tags: DataFrame) -> DataFrame:
    """``fragment_tags`` without what fragments inherited by ``links`` (``note_id``, ``tag_id``)."""
    gone = fragments.select("fragment_id", "note_id").join(links.select("note_id", "tag_id"), "note_id").select("fragment_id", "tag_id")
    own = fragment_tags.where("source <> 'inherited'")
    return own.unionByName(fragment_tags.where("source = 'inherited'").join(gone, ["fragment_id", "tag_id"], "left_anti"))

"""Trees of notes and tags: paths, closures, roll-ups.

Subtree questions are answered by exploding each node into its ancestors, an equi-join, instead of
comparing path prefixes pair by pair.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import bounded, kept


def tree_paths(nodes: DataFrame, orphans: bool = False) -> DataFrame:
    """``nodes`` (``id``, ``parent_id``, ``name``) reachable from roots, with ``path``, ``depth`` and
    ``ancestors`` (ids from the root to the node itself); nodes in or below a cycle are not.

    By pointer doubling: a row knows the ids and names up to some ancestor, and takes over what that one
    knows; the number of rounds is the logarithm of the depth, whatever it is.  Two parts of a way that
    share an id are a cycle.  With ``orphans`` a node whose parent isn't among ``nodes`` is a root too.
    """
    up = F.col("parent_id")
    if orphans:
        known = nodes.select(F.col("id").alias("_known")).distinct()
        nodes_ = nodes.join(known, up == F.col("_known"), "left")
        up = F.col("_known")
    else:
        nodes_ = nodes
    rows = kept(nodes_.select("id", "parent_id", "name", up.alias("_up"), F.col("name").alias("path"), F.array("id").alias("ancestors")))
    while not (open_ := rows.where("_up IS NOT NULL")).isEmpty():
        above = rows.select(F.col("id").alias("_id"), F.col("_up").alias("_next"), F.col("path").alias("_path"), F.col("ancestors").alias("_above"))
        joined = open_.join(bounded(above), F.col("_up") == F.col("_id")).where(~F.arrays_overlap("_above", "ancestors"))
        longer = joined.select("id", "parent_id", "name", F.col("_next").alias("_up"), F.concat_ws("/", "_path", "path").alias("path"), F.concat("_above", "ancestors").alias("ancestors"))
        rows = kept(rows.where("_up IS NULL").unionByName(longer))
    return rows.select("id", "parent_id", "name", "path", (F.size("ancestors") - 1).cast("long").alias("depth"), "ancestors")


def depths(nodes: DataFrame) -> DataFrame:
    """``id`` and ``depth`` (0 for roots) of the ``nodes`` (``id``, ``parent_id``) that reach a root, by
    pointer doubling over numbers alone."""
    up = F.col("parent_id")
    rows = kept(nodes.select("id", up.alias("_up"), up.isNotNull().cast("long").alias("depth")))
    for _ in range(rows.count().bit_length() + 1):  # a way without a cycle is no longer than there are nodes
        if (open_ := rows.where("_up IS NOT NULL")).isEmpty():
            break
        above = rows.select(F.col("id").alias("_id"), F.col("_up").alias("_next"), F.col("depth").alias("_depth"))
        longer = open_.join(bounded(above), F.col("_up") == F.col("_id")).select("id", F.col("_next").alias("_up"), (F.col("depth") + F.col("_depth")).alias("depth"))
        rows = kept(rows.where("_up IS NULL").unionByName(longer))
    return rows.where("_up IS NULL").select("id", "depth")


def roots(nodes: DataFrame) -> DataFrame:
    """``id`` and ``root`` (itself for roots) of the ``nodes`` (``id``, ``parent_id``), null in or below a
    cycle or a missing parent; by pointer doubling."""
    rows = kept(nodes.select("id", F.col("parent_id").alias("_up"), F.when(F.col("parent_id").isNull(), F.col("id")).alias("root")))
    for _ in range(rows.count().bit_length() + 1):
        if (open_ := rows.where("_up IS NOT NULL")).isEmpty():
            break
        above = rows.select(F.col("id").alias("_id"), F.col("_up").alias("_next"), F.col("root").alias("_root"))
        longer = open_.join(bounded(above), F.col("_up") == F.col("_id"), "left").select("id", F.col("_next").alias("_up"), F.col("_root").alias("root"))
        rows = kept(rows.where("_up IS NULL").unionByName(longer))
    return rows.select("id", F.when(F.col("_up").isNull(), F.col("root")).alias("root"))


def below(rows: DataFrame, key: str, parent: str, node) -> DataFrame:
    """``id`` of a node and of all below it, by pointer doubling: every row learns whether its way up
    comes to the node, in as many rounds as the logarithm of the depth."""
    own = F.col(key) == F.lit(node)
    found = kept(rows.select(F.col(key).alias("id"), F.when(~own, F.col(parent)).alias("_up"), own.alias("_hit")))
    for _ in range(found.count().bit_length() + 1):
        if (open_ := found.where("_up IS NOT NULL")).isEmpty():
            break
        above = found.select(F.col("id").alias("_id"), F.col("_up").alias("_next"), F.col("_hit").alias("_above"))
        longer = open_.join(bounded(above), F.col("_up") == F.col("_id")).select("id", F.col("_next").alias("_up"), F.col("_above").alias("_hit"))
        found = kept(found.where("_up IS NULL").unionByName(longer))
    return found.where("_up IS NULL AND _hit").select("id")


def closure(paths: DataFrame) -> DataFrame:
    """``ancestor_id``, ``descendant_id``, ``depth`` (0 for a node itself) from ``tree_paths``."""
    pairs = paths.select(F.col("id").alias("descendant_id"), F.size("ancestors").alias("_n"), F.posexplode("ancestors").alias("_at", "ancestor_id"))
    return pairs.select("ancestor_id", "descendant_id", (F.col("_n") - 1 - F.col("_at")).cast("long").alias("depth"))


def roll_up(paths: DataFrame, counts: DataFrame, *values: str) -> DataFrame:
    """For each node the sums of ``values`` over its subtree; ``counts`` has ``id`` and the values."""
    joined = closure(paths).join(counts.withColumnRenamed("id", "_of"), F.col("descendant_id") == F.col("_of"), "left")
    sums = [F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(v) for v in values]
    return joined.groupBy(F.col("ancestor_id").alias("id")).agg(*sums)


def due_counts(schedules: DataFrame, cards: DataFrame, now: Column) -> DataFrame:
    """``id`` (note) and ``due``: schedules of the note itself and of its cards that are not suspended."""
    due = schedules.where(F.col("next_review") <= now)
    own = due.where("target_type = 'note'").groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("due"))
    live = cards.where("status <> 'suspended'").select("card_id", "note_id")
    by_card = due.where("target_type = 'card'").join(live, F.col("target_id") == F.col("card_id"))
    by_card = by_card.groupBy(F.col("note_id").alias("id")).agg(F.count(F.lit(1)).alias("due"))
    return own.unionByName(by_card).groupBy("id").agg(F.sum("due").alias("due"))


def own_counts(schedules: DataFrame, cards: DataFrame, now: Column) -> DataFrame:
    """``id`` (note) and its own cards that are not suspended: ``due``, ``new`` and ``total``."""
    planned = schedules.where("target_type = 'card'")
    state = F.col("state") if "state" in schedules.columns else F.lit(None).cast("string")
    planned = planned.select("target_id", "next_review", state.alias("state"))
    live = cards.where("status <> 'suspended'").join(planned, F.col("card_id") == F.col("target_id"), "left")
    counts = [F.count_if(F.col("next_review") <= now).alias("due"), F.count_if(F.col("state") == "new").alias("new"), F.count(F.lit(1)).alias("total")]
    return live.groupBy(F.col("note_id").alias("id")).agg(*counts)


def repeat_tree(paths: DataFrame, schedules: DataFrame, cards: DataFrame, now: Column) -> DataFrame:
    """``id``, ``name``, ``parent_id``, ``path``, ``depth``, own and subtree numbers of due and of all
    cards and own new ones, ordered by path."""
    own = own_counts(schedules, cards, now)
    below = roll_up(paths, own, "due", "total").select("id", F.col("due").alias("subtree_due"), F.col("total").alias("subtree_total"))
    joined = paths.select("id", "name", "parent_id", "path", "depth").join(own, "id", "left").join(below, "id")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(f"own_{c}")
    return joined.select("id", "name", "parent_id", "path", "depth", zero("due"), zero("new"), zero("total"), "subtree_due", "subtree_total").orderBy("path")


def visible_due_counts(notes: DataFrame, schedules: DataFrame, cards: DataFrame, now: Column) -> DataFrame:
    """``id`` and ``due`` in its subtree for each note (``id``, ``parent_id``, ``lifecycle``) that isn't deleted.
    A note below a deleted one heads a tree of its own; what hangs on deleted notes counts nowhere."""
    seen = notes.where("lifecycle <> 'deleted'").select("id", "parent_id", F.col("id").cast("string").alias("name"))
    return roll_up(tree_paths(seen, orphans=True), due_counts(schedules, cards, now), "due")


def active_repeat_tree(notes: DataFrame, schedules: DataFrame, cards: DataFrame, now: Column) -> DataFrame:
    """``repeat_tree`` over the active notes (``id``, ``parent_id``, ``name``, ``path``, ``lifecycle``) that active
    ones join to a root; orphans aren't listed.  Numbers of a subtree count by the notes' cached paths, so
    they hold the cards of all notes there, whatever their lifecycle."""
    tree = tree_paths(notes.where("lifecycle = 'active'")).select("id", "name", "parent_id", "depth")
    cached = notes.select(F.col("id").alias("_id"), "path")
    listed = tree.join(cached, F.col("id") == F.col("_id")).drop("_id")
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    own = own_counts(schedules, cards, now)
    under = notes.select("id", F.explode(prefixes).alias("_path")).join(own, "id").groupBy("_path")  # an equi-join instead of path prefixes
    sums = under.agg(F.sum("due").alias("subtree_due"), F.sum("total").alias("subtree_total"))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    joined = listed.join(own, "id", "left").join(sums, F.col("path") == F.col("_path"), "left")
    return joined.select("id", "name", "parent_id", "path", "depth", zero("due", "own_due"), zero("new", "own_new"), zero("total", "own_total"),
                         zero("subtree_due", "subtree_due"), zero("subtree_total", "subtree_total")).orderBy("path")


def tags_of_strings(paths: DataFrame) -> DataFrame:
    """All levels of tag strings (``path``, with slashes): ``path``, ``parent_path``, ``name``, ``depth``."""
    parts = F.split(F.lower(F.btrim("path")), "/")
    levels = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(
        F.array_join(F.slice(parts, 1, n), "/").alias("path"),
        F.when(n > 1, F.array_join(F.slice(parts, 1, n - 1), "/")).alias("parent_path"),
        F.element_at(parts, n).alias("name"), (n - 1).cast("long").alias("depth")))
    return paths.select(F.inline(levels)).distinct()


def tagged(note_tags: DataFrame, closure_rows: DataFrame, tag_id: Column, subtree: bool = True) -> DataFrame:
    """``note_id`` of the notes with a tag, or with any tag below it."""
    below = closure_rows.where(F.col("ancestor_id") == tag_id)
    below = below if subtree else below.where("depth = 0")
    return note_tags.join(below, F.col("tag_id") == F.col("descendant_id"), "left_semi").select("note_id").distinct()


def moved_closure(closure_rows: DataFrame, moved: int, new_parent: int) -> DataFrame:
    """The closure after a subtree moved under another tag; an error where that would be a cycle."""
    subtree = closure_rows.where(F.col("ancestor_id") == moved).select(F.col("descendant_id").alias("_d"), F.col("depth").alias("_below"))
    if not subtree.where(F.col("_d") == new_parent).isEmpty():
        raise ValueError("a tag can't move below itself")
    subtree = kept(subtree)
    inside = closure_rows.join(bounded(subtree.select("_d")), F.col("descendant_id") == F.col("_d"), "left_semi")
    cut = inside.join(bounded(subtree.select("_d")), F.col("ancestor_id") == F.col("_d"), "left_anti")
    left = closure_rows.join(cut, ["ancestor_id", "descendant_id"], "left_anti")
    above = closure_rows.where(F.col("descendant_id") == new_parent).select("ancestor_id", F.col("depth").alias("_above"))
    # The new parent has as many ancestors as the tree has levels above it, however large the subtree is.
    added = subtree.crossJoin(F.broadcast(above)).select("ancestor_id", F.col("_d").alias("descendant_id"), (F.col("_above") + F.col("_below") + 1).alias("depth"))
    return left.unionByName(added)


def autocomplete(tags: DataFrame, links: DataFrame, prefix: str, limit: int) -> DataFrame:
    """Tags whose path or name starts with ``prefix``: most used first, then the shallower ones."""
    prefix = prefix.lower()
    used = links.groupBy(F.col("tag_id").alias("_tag")).agg(F.count(F.lit(1)).alias("uses"))
    fitting = tags.where(F.lower("path").startswith(prefix) | F.lower("name").startswith(prefix))
    joined = fitting.join(used, F.col("tag_id") == F.col("_tag"), "left").withColumn("uses", F.coalesce("uses", F.lit(0)).cast("long"))
    return joined.drop("_tag").orderBy(F.desc("uses"), "depth", "tag_id").limit(limit)


def inherited(note_tags: DataFrame, fragments: DataFrame, fragment_tags: DataFrame) -> DataFrame:
    """``fragment_id``, ``tag_id`` that fragments inherit from their notes and don't have yet."""
    wanted = fragments.select("fragment_id", "note_id").join(note_tags.select("note_id", "tag_id"), "note_id").select("fragment_id", "tag_id")
    return wanted.join(fragment_tags, ["fragment_id", "tag_id"], "left_anti")

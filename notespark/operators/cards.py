"""Cards and their schedules: making, rendering, changing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import kept
from .indexing import replaced
from .store import _among, _rewritten, with_ids


def inserted(cards: DataFrame, schedules: DataFrame, new: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Cards and schedules with ``new`` cards (``note_id``, ``section_id``, ``card_type``, ...): fresh, each
    with a new schedule that isn't due before its first review is set."""
    stamped = new.withColumns({"status": F.lit("fresh"), "created_at": F.lit(now).cast("long"), "updated_at": F.lit(now).cast("long")})
    rows = kept(with_ids(stamped, cards, "card_id", "note_id", "section_id"))
    planned = rows.select(F.lit("card").alias("target_type"), F.col("card_id").alias("target_id"), F.lit("new").alias("state"))
    planned = with_ids(planned, schedules, "schedule_id", "target_id")
    return cards.unionByName(rows, allowMissingColumns=True), schedules.unionByName(planned, allowMissingColumns=True)


def of_note(cards: DataFrame, note_id: int) -> DataFrame:
    return cards.where(F.col("note_id") == note_id).orderBy("card_id")


def updated(cards: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """``cards`` with front, back, status and snapshot of ``new`` (by ``card_id``)."""
    columns = ["custom_front", "custom_back", "status", "last_section_snapshot"]
    values = new.select(F.col("card_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined, hit = cards.join(values, F.col("card_id") == F.col("_id"), "left"), F.col("_id").isNotNull()
    changes = {c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    changes["updated_at"] = F.when(hit, F.lit(now).cast("long")).otherwise(F.col("updated_at"))
    return joined.withColumns(changes).select(*cards.columns)


def marked_stale(cards: DataFrame, sections: DataFrame) -> DataFrame:
    """``cards`` of the sections (ids), but suspended ones, are stale."""
    return _rewritten(cards, sections, "section_id", {"status": F.when(F.col("status") != "suspended", "stale").otherwise(F.col("status"))})


def rendered(cards: DataFrame, sections: DataFrame, notes: DataFrame) -> DataFrame:
    """``card_id``, ``front``, ``back``, ``card_type`` and the note of each card.

    A heading card shows the section's heading and text unless it has its own; a question or manual
    card shows its own; a cloze card shows the text on both sides (masks aren't applied).  Without a
    section the text is the last snapshot.
    """
    at = sections.select(F.col("section_id").alias("_section"), "heading", "text_raw")
    titles = notes.select(F.col("note_id").alias("_note"), F.col("title").alias("note_title"), F.col("path_cached").alias("note_path"))
    rows = cards.join(at, F.col("section_id") == F.col("_section"), "left").join(titles, F.col("note_id") == F.col("_note"))
    missing = F.col("_section").isNull()
    text = F.when(missing, F.coalesce("last_section_snapshot", F.lit(""))).otherwise(F.col("text_raw"))
    heading = F.when(missing, "Orphaned Section").otherwise(F.coalesce("heading", F.lit("Untitled Section")))
    kind = F.col("card_type")
    front = F.when(kind == "cloze", text).when(kind == "heading", F.coalesce("custom_front", heading)).otherwise(F.coalesce("custom_front", F.lit("")))
    back = F.when(kind == "cloze", text).when(kind == "heading", F.coalesce("custom_back", text)).otherwise(F.coalesce("custom_back", F.lit("")))
    return rows.select("card_id", front.alias("front"), back.alias("back"), "card_type", "note_id", "note_title", "note_path")


def refreshed(cards: DataFrame, sections: DataFrame, rewrite, now: int) -> DataFrame:
    """Stale cards with front and back that ``rewrite`` (from text, front and back columns to a struct
    of ``front`` and ``back``) makes of the section as it is now; they are fresh again."""
    at = sections.select(F.col("section_id").alias("_section"), "text_raw")
    stale = cards.where("status = 'stale'").join(at, F.col("section_id") == F.col("_section"))
    made = kept(stale.select("card_id", rewrite(F.col("text_raw"), F.col("custom_front"), F.col("custom_back")).alias("x"), "text_raw"))
    new = made.select("card_id", F.col("x.front").alias("custom_front"), F.col("x.back").alias("custom_back"), F.lit("fresh").alias("status"), F.col("text_raw").alias("last_section_snapshot"))
    return updated(cards, new, now)


# Schedules


def schedule_of(schedules: DataFrame, target_type: str, target_id: int) -> DataFrame:
    return schedules.where((F.col("target_type") == target_type) & (F.col("target_id") == target_id))


def with_states(schedules: DataFrame, states: DataFrame) -> DataFrame:
    """``schedules`` with the memory states of ``states`` (as ``review.fold_reviews`` yields them)."""
    columns = ["state", "stability", "difficulty", "reps", "lapses", "last_reviewed", "next_review"]
    keep = [c for c in schedules.columns if c not in columns]
    new = schedules.select(*keep).join(states.select("schedule_id", *columns), "schedule_id")
    return replaced(schedules, new.select(*schedules.columns), ["schedule_id"])


def with_next_review(schedules: DataFrame, ids: DataFrame, at: int) -> DataFrame:
    return _rewritten(schedules, ids, "schedule_id", {"next_review": F.lit(at).cast("long")})


def without_target(schedules: DataFrame, target_type: str, ids: DataFrame) -> DataFrame:
    """``schedules`` without those of the targets in ``ids``."""
    gone = _among(schedules.where(F.col("target_type") == target_type), ids, "target_id").select("schedule_id")
    return _among(schedules, gone, "schedule_id", "left_anti")

"""Reading and writing note collections."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..operators.store import inserted_notes
from ..schemas import SCHEMAS


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """One row a Markdown file below ``path``: title (the file's stem), content, hash, status."""
    files = spark.read.format("text").options(wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").load(path)
    name = F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return files.select(
        F.coalesce(F.nullif(stem, F.lit("")), F.lit("Untitled")).alias("title"),
        F.col("value").alias("content"),
        content_hash(F.col("value")).alias("content_hash"),
        F.lit("pending").alias("indexing_status"),
    )


def read_calibration_pairs(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("query string, expectedNoteTitle string, relevanceWeight double").json(path, multiLine=True)
    return rows.select("query", F.col("expectedNoteTitle").alias("expected_note_title"), F.coalesce("relevanceWeight", F.lit(1.0)).alias("relevance_weight"))


def seeded_pairs(notes: DataFrame) -> DataFrame:
    """Calibration pairs from titles: the title itself, and as a question with less weight."""
    as_is = notes.select(F.col("title").alias("query"), F.col("title").alias("expected_note_title"), F.lit(1.0).alias("relevance_weight"))
    asked = notes.select(F.concat(F.lit("what is "), F.lower("title")).alias("query"), F.col("title").alias("expected_note_title"), F.lit(0.88).alias("relevance_weight"))
    return as_is.unionByName(asked)


def append(rows: DataFrame, root: str, name: str) -> None:
    """Append-only tables (review logs, revisions)."""
    rows.write.mode("append").parquet(f"{root}/{name}")


def import_markdown(spark: SparkSession, path: str, notes: DataFrame, now: int) -> DataFrame:
    """``notes`` and the Markdown files below ``path``, as pending notes at the root; all of them or none,
    as nothing is written here."""
    files = read_markdown(spark, path).select("title", "content", F.lit(None).cast("long").alias("parent_note_id"))
    return inserted_notes(notes, files, now)


def indexed_or_failed(notes: DataFrame, cut: Callable[[str], list], key: str = "note_id", text: str = "content") -> DataFrame:
    """What ``cut`` yields for each note, or why it failed (``key``, ``fragments``, ``error``): a note that
    can't be read doesn't stop the others."""

    @F.pandas_udf("fragments array<string>, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                rows.append((list(cut(t or "")), None))
            except Exception as e:
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["fragments", "error"])

    return notes.select(key, run(F.col(text)).alias("x")).select(key, "x.fragments", "x.error")


def compacted(spark: SparkSession, root: str, name: str, target: str, files: int) -> None:
    """A table written anew with fewer files; the caller puts it in place of the old one."""
    read_table(spark, root, name).repartition(files).write.mode("overwrite").parquet(f"{target}/{name}")

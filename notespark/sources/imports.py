"""Import of a folder of notes: read, cut, embedded and indexed in one run, with what failed set aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import with_ids
from ..streaming.index import IndexTables
from ..tables import KeyedTable, kept


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``title``, ``content``, ``error`` of the Markdown files below ``path``, a row each: a file that is
    no UTF-8 has an error in place of its content.  Files are read where they are, by Spark's own reader."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.md").load(path)
    name = F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
    title = F.coalesce(F.nullif(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("")), F.lit("Untitled"))
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    return files.select(
        "path",
        title.alias("title"),
        F.when(valid, F.regexp_replace(text, "^\ufeff", "")).alias("content"),
        F.when(~valid, F.lit("not valid UTF-8")).alias("error"),
        F.col("modificationTime").alias("at"),
    )


class Imports:
    """Which file became which note, beside the tables of an index.  A run is one generation of all of them,
    and its own mark comes last: a run that dies leaves nothing that readers see, and is run again."""

    def __init__(self, tables: IndexTables):
        self.tables, self.spark = tables, tables.spark
        self.files = KeyedTable(self.spark, f"{tables.path}/files", "path string, note_id long, title string, error string", "path")

    def run(self, path: str, generation: int) -> DataFrame:
        """Brings the index up to the folder and returns a row for each file: ``path``, ``note_id``, ``title``,
        ``n_fragments``, ``error`` (of reading or embedding).  Known files keep their notes; files that are no
        longer there take their notes away; broken ones leave theirs as they were."""
        found = kept(read_notes(self.spark, path))
        known = kept(self.files.live(generation))
        held = known.select(F.col("path").alias("_path"), "note_id")
        joined = found.join(held, F.col("path") == F.col("_path"), "left").drop("_path")
        old, new = joined.where("note_id IS NOT NULL"), kept(joined.where("note_id IS NULL").drop("note_id"))
        rows = kept(old.unionByName(with_ids(new, known, "note_id", "path")))
        gone = kept(known.join(found.select("path"), "path", "left_anti"))
        batch = rows.where("error IS NULL").select("note_id", "content", "at")
        self.tables.apply(batch.unionByName(gone.select("note_id", F.lit(None).cast("string").alias("content"), F.current_timestamp().alias("at"))), generation)
        failed = self.tables.failures().groupBy("note_id").agg(F.min("error").alias("_error"))
        report = kept(rows.join(failed, "note_id", "left").select("path", "note_id", "title", F.coalesce("error", "_error").alias("error")))
        self.files.put(generation, report, gone.select("path"))
        counts = self.tables.fragments().groupBy("note_id").agg(F.count(F.lit(1)).alias("_n"))
        return report.join(counts, "note_id", "left").select("path", "note_id", "title", F.coalesce("_n", F.lit(0)).alias("n_fragments"), "error")

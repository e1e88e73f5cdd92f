"""Tables kept between jobs, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a few numbers that a join may send to all executors.
BROADCAST_ROWS = 300_000


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; set here only where it is unset, and in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="notespark-checkpoints-"))
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once: written in ``spark.checkpoint.dir`` and read again, so that neither lineage
    nor what the optimizer knows of it grows with rounds.  A folder of its own is set only where that
    setting is missing, and in local mode only; tables stay until the folder is cleaned up."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame) -> DataFrame:
    """A kept table, with the hint to broadcast it only if it is small; a larger one is shuffled, even where
    its files are so small that Spark would send it through the driver."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def numbered(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """``df`` with its number (from 0) in ``order``, without bringing all rows to one task: a range
    sort, and for each of its partitions the number of rows before it."""
    number = F.monotonically_increasing_id()  # the partition above 33 bits of the place in it
    shared_folder(df.sparkSession)
    placed = df.orderBy(*order).checkpoint().select("*", F.shiftright(number, 33).alias("_part"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select(F.col("_part").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    joined = placed.join(F.broadcast(before), F.col("_part") == F.col("_of"))  # a row for each partition
    return joined.withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_part", "_at", "_of", "_before")


class KeyedTable:
    """Rows with a key in a folder that the cluster shares, cut by generation.  A generation holds the rows
    that came or changed and the keys that it replaces or takes away; nothing before it is rewritten.  Its
    mark is written last: without it a generation doesn't exist, and writing one again replaces it."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key
        self.kind = spark.createDataFrame([], schema).schema[key].dataType.simpleString()

    def put(self, generation: int, rows: DataFrame, gone: DataFrame | None = None) -> None:
        """Adds ``rows`` (one for a key at most) in place of those with their keys, without the keys ``gone``."""
        write = lambda df, name: df.write.mode("overwrite").parquet(f"{self.path}/{name}/generation={generation}")
        names = self.spark.createDataFrame([], self.schema).columns
        write(rows.select(*names), "rows")
        keys = self._folder("rows", self.schema).where(F.col("generation") == generation).select(self.key)
        write(keys if gone is None else keys.unionByName(gone.select(self.key)).distinct(), "gone")
        write(self.spark.range(1).coalesce(1), "done")

    def generations(self) -> list[int]:
        rows = self._folder("done", "id long")
        return [] if rows is None else sorted(r[0] for r in rows.select("generation").distinct().collect())  # one row each

    def live(self, below: int | None = None) -> DataFrame:
        """The rows as they are, or as they were before generation ``below``."""
        known = [g for g in self.generations() if below is None or g < below]
        if not known:
            return self.spark.createDataFrame([], self.schema)
        of = F.col("generation").isin(known)
        last = self._folder("gone", f"{self.key} {self.kind}").where(of).groupBy(F.col(self.key).alias("_key")).agg(F.max("generation").alias("_last"))
        rows = self._folder("rows", self.schema).where(of).join(bounded(kept(last)), F.col(self.key) == F.col("_key"))
        return rows.where(F.col("generation") == F.col("_last")).drop("_key", "_last", "generation")

    def _folder(self, name: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(f"{schema}, generation int").parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

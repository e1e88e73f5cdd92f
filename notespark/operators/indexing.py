"""Incremental indexing: differences by position and hash, drift, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import defaults as d


def fragment_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both have note_id, order_index, hash.  ``change``: insert, delete, update or same."""
    keys = ["note_id", "order_index"]
    a, b = old.select(*keys, F.col("hash").alias("old_hash")), new.select(*keys, F.col("hash").alias("new_hash"))
    change = (
        F.when(F.col("old_hash").isNull(), "insert").when(F.col("new_hash").isNull(), "delete")
        .when(F.col("old_hash") == F.col("new_hash"), "same").otherwise("update")
    )
    return a.join(b, keys, "full").withColumn("change", change)


def deduplicated(fragments: DataFrame) -> DataFrame:
    """The first fragment of each hash within a note."""
    order = Window.partitionBy("note_id", "hash").orderBy("order_index")
    return fragments.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def replaced(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` with the rows of ``new`` in place of those with equal keys."""
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new)


def needs_indexing(model: str, version: str) -> Column:
    stale = F.col("indexing_status").isin("failed", "pending", "stale")
    other = ~F.col("embedding_model").eqNullSafe(F.lit(model)) | ~F.col("indexing_version").eqNullSafe(F.lit(version))
    return (F.col("lifecycle") != "deleted") & (stale | other)


def drifted(model: str, dimension: int) -> Column:
    same = F.col("embedding_model").eqNullSafe(F.lit(model)) & F.col("embedding_dimension").eqNullSafe(F.lit(dimension))
    return (F.col("indexing_status") == "indexed") & ~same


def cache_lookup(wanted: DataFrame, cache: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``wanted`` with ``value`` (null on a miss) and ``hit``."""
    held = cache.select(*keys, value).dropDuplicates(keys)
    return wanted.join(held, keys, "left").withColumn("hit", F.col(value).isNotNull())


def fresh_cache(cache: DataFrame, model: str, now: int) -> DataFrame:
    return cache.where((F.col("model") == model) & (F.col("created_at") >= now - d.CACHE_SECONDS))


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)

"""Mixing sources to target weights, by DataFrame functions only.

Every document gets a hash-random key; within its source the documents are sorted by that key, a
distributed prefix sum of their sizes runs over the order, and the source's budget cuts it: the
budget's whole multiples of the source's size repeat all of it (epochs), the rest takes documents
from the front, the last of them in part, so that the budget is met to the word.

How the prefix sum is distributed: a source's key range is divided into equal buckets.  Keys are
uniform, so buckets are even whatever the source's share; one small aggregate has the size of each
bucket, its running sum gives each bucket an offset, and a window within the bucket does the rest.
There are about sqrt(rows) buckets, so neither a bucket nor the list of buckets becomes large.
Rows that agree in doc_id and text have one key; they are counted first and expanded last.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize, n_words

#: No source gives more than this many times its size.
EPOCHS = 3

_KEY_SPAN = 1 << 32
#: Copies of a row that are expanded at once.
_CHUNK = 4096


def source_targets(sizes: DataFrame, weight: Column, epochs: int = EPOCHS) -> DataFrame:
    """``sizes`` (one row a source, ``source_size`` long) with ``target`` double.

    The sources share the sum of all sizes by ``weight``; a target stops at ``epochs`` times its
    source's size and the excess is shared again by weight among the others, until none is above.
    Each round is one aggregate of one row; the sources themselves stay distributed.
    """
    weighted = sizes.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * epochs)
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0  # what one unit of weight gets
    while True:
        capped = F.col("_cap") <= F.col("_weight") * F.lit(level)
        spent, weights = weighted.agg(
            F.coalesce(F.sum(F.when(capped, F.col("_cap"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("_weight"))), F.lit(0)),
        ).first()
        following = (total - spent) / weights if weights else level
        if following <= level:
            break
        level = following
    target = F.least(F.col("_cap").cast("double"), F.col("_weight") * F.lit(level))
    return weighted.withColumn("target", target).drop("_weight", "_cap")


def cyclic_weights(sizes: DataFrame, cycle: int = 3) -> DataFrame:
    """Adds ``_rank_weight``: 1, 2, ..., ``cycle``, repeating over the sources by code point, null last.

    The rank comes from a range sort: a source's place in its partition, and the number of sources
    in the partitions before, of which there is one row each.
    """
    ordered = materialize(sizes.orderBy(F.col("source").isNull(), "source"))
    number = F.monotonically_increasing_id()  # the partition above 33 bits of the place in it
    placed = ordered.select("*", F.shiftright(number, 33).alias("_part"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select(F.col("_part").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = placed.join(F.broadcast(before), F.col("_part") == F.col("_of"))
    weight = ((F.col("_before") + F.col("_at")) % cycle + 1).alias("_rank_weight")
    return ranked.select(*sizes.columns, weight)


def _expanded(groups: DataFrame) -> DataFrame:
    """A row for each of the ``copies``, numbered by ``_copy`` from 0.  Arrays have ``_CHUNK`` elements
    at most, and groups of more copies are dealt over all tasks."""
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    few, many = groups.where(F.col("copies") <= _CHUNK), groups.where(F.col("copies") > _CHUNK)
    rows = few.withColumn("_copy", numbers(F.col("copies")))
    if many.isEmpty():
        return rows
    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = many.withColumn("_chunk", numbers(F.ceil(F.col("copies") / _CHUNK))).repartition(tasks)
    left = F.least(F.lit(_CHUNK), F.col("copies") - F.col("_chunk") * _CHUNK)
    dealt = dealt.withColumn("_in", numbers(left)).withColumn("_copy", F.col("_chunk") * _CHUNK + F.col("_in"))
    return rows.unionByName(dealt.drop("_chunk", "_in"))


def mix_sources(docs: DataFrame, seed: str = "mix", epochs: int = EPOCHS, cycle: int = 3) -> DataFrame:
    """The mix of all ``docs`` (``doc_id``, ``text``, ``source``): doc_id, source, size, source_size,
    target, taken.

    ``taken`` counts the words the mix takes of a row, repeats included: whole epochs take all of
    them, the document at the cut gives its first words only.  Sums of ``taken`` meet the targets,
    rounded to a word.

    Nulls and other cases: a null text has size 0, a null source is a source of its own and comes
    last, a null doc_id counts as the text "null" in the key.  Empty texts are taken 0 times their 0
    words.  The key follows doc_id and text, so rows without doc_ids or with equal ones are spread
    like others; rows that agree in both are counted before they are shuffled, lie side by side in
    the order and each have a row in the result.  An empty table gives an empty result.  Extra
    columns are left out, so their names can't clash.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    key = F.md5(F.concat(name, F.lit(":"), F.md5(F.coalesce("text", F.lit(""))), F.lit(f":{seed}")))
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("_key"))
    rows = materialize(rows.groupBy("doc_id", "source", "size", "_key").agg(F.count(F.lit(1)).alias("copies")))
    n = rows.count()
    buckets = max(1, math.isqrt(n))
    high = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("_bucket", F.floor(high * buckets / F.lit(_KEY_SPAN)).cast("long"))
    rows = rows.withColumn("_words", F.col("size") * F.col("copies"))

    by_bucket = materialize(rows.groupBy("source", "_bucket").agg(F.sum("_words").alias("_in_bucket")))
    sizes = by_bucket.groupBy("source").agg(F.sum("_in_bucket").alias("source_size"))
    sizes = materialize(cyclic_weights(sizes, cycle))
    targets = source_targets(sizes, F.col("_rank_weight"), epochs).drop("_rank_weight")

    running = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.withColumn("_offset", F.coalesce(F.sum("_in_bucket").over(running), F.lit(0)))
    cuts = offsets.withColumnRenamed("source", "_source").join(
        targets, F.col("_source").eqNullSafe(F.col("source"))
    ).select("_source", F.col("_bucket").alias("_of"), "_offset", "source_size", "target")

    within = (
        Window.partitionBy("source", "_bucket")
        .orderBy("_key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = rows.withColumn("_before", F.coalesce(F.sum("_words").over(within), F.lit(0)))
    placed = placed.join(cuts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_of")))
    placed = _expanded(placed)
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - whole * F.col("source_size")
    before = F.col("_offset") + F.col("_before") + F.col("_copy") * F.col("size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    taken = (whole * F.col("size") + part).cast("long").alias("taken")
    return placed.select("doc_id", "source", "size", "source_size", "target", taken)

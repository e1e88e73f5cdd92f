"""Connected components over tables of links, by alternating large-star and small-star rounds.

Nothing is collected but one row of counts a round.  Joins are between plain tables (the grouped
side is materialized first), so that adaptive execution can split a node with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize


def _state(links: DataFrame) -> tuple:
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(links.agg(F.count(F.lit(1)), digest).first())


def _nearest(links: DataFrame) -> DataFrame:
    return materialize(links.groupBy("u").agg(F.min("v").alias("m"))).withColumnRenamed("u", "n")


def connected_components(links: DataFrame) -> DataFrame:
    """``links``: two long columns ``u`` and ``v``, any order, repeats and loops allowed.

    Returns ``node, root`` for every node that has a link to another; ``root`` is the smallest node
    of its component and has no row of its own.  An empty table gives an empty result.
    """
    u, v = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    links = materialize(links.where("u <> v").select(u, v).distinct())
    state = _state(links)
    while state[0]:
        both = links.union(links.select("v", "u"))
        joined = both.join(_nearest(both), F.col("u") == F.col("n")).where("v > u")
        large = materialize(joined.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())

        near = _nearest(large)
        joined = large.join(near, F.col("u") == F.col("n")).where("v <> m")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = materialize(small.union(near.select("n", "m")).distinct())
        before, state = state, _state(links)
        if state == before:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))

import pytest
from pyspark.sql import functions as F

from notespark import tables
from notespark.operators import hierarchy
from notespark.operators.distribute import creation_levels, resolve_merges


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", [creation_levels, resolve_merges])
def test_tables_of_many_rows_and_few_bytes_are_shuffled(spark, monkeypatch, how):
    column = "parent_index" if how is creation_levels else "merge_into"
    plan = spark.range(200).select(F.col("id").alias("chunk_index"), F.when(F.col("id") % 10 > 0, F.col("id") - 1).alias(column))
    want = sorted(map(tuple, how(plan).collect()))
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 10)
    found = how(plan)
    assert "Broadcast" not in _plan(found) and sorted(map(tuple, found.collect())) == want
    other = tables.bounded(tables.kept(spark.range(50)))
    assert "Broadcast" not in _plan(spark.range(20).join(other, "id")) and "Broadcast" not in _plan(hierarchy.depths(spark.range(9).selectExpr("id", "id - 1 parent_id")))

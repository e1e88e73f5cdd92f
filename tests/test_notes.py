import pytest
from pyspark.sql import functions as F

from notespark.functions import notes as n
from notespark.functions.models import HashingEmbedder
from notespark.plans.index import index


def test_plain_functions():
    assert n.detect_language("der Hund und die Katze") == "de" and n.detect_language("123") == "en"
    assert "+Line two is added" in n.revision_patch("Line one of text", "Line one of text\nLine two is added")
    table = "| a | b |\n|---|---|\n| 1 | 2 |\n|  |  |\n| 3 | |"
    assert n.linear_table(table) == "1. a: 1. b: 2\n2. a: 3" and n.linear_table("| a |") == "| a |"
    assert n.split_tables(f"x\n{table}\ny") == [(False, "x"), (True, table), (False, "y")]
    a, b = HashingEmbedder(16).embed(["atoms", ""])
    assert sum(x * x for x in a) == pytest.approx(1) and not any(b)


def test_index_is_idempotent(spark):
    notes = spark.createDataFrame([(1, "## Math\ntext one\n## Calculus\ntext two")], "note_id long, content string")
    none = spark.createDataFrame([], "note_id long, order_index long, hash string")
    cache = spark.createDataFrame([], "hash string, model string, embedding array<float>")
    changes, now = index(notes, none, cache, HashingEmbedder(8))
    assert [r.change for r in changes.collect()] == ["insert", "insert"] and now.where(F.size("embedding") == 8).count() == 2
    again, _ = index(notes, now.select("note_id", "order_index", "hash"), cache, HashingEmbedder(8))
    assert {r.change for r in again.collect()} == {"same"}

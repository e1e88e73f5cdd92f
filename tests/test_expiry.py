from datetime import datetime, timedelta

from pyspark.sql import functions as F

from notespark.streaming.expiry import cached_requests, in_rocks
from notespark.streaming.jobs import written_stream

START = datetime(2024, 1, 1)


def _day(n):
    return START + timedelta(days=n)


def test_an_entry_of_31_days_is_gone(spark, tmp_path):
    first = [("a", "a0", _day(0)), ("a", "a1", _day(29)), ("b", "b0", _day(0)), (None, "x", _day(1))]
    second = [("a", "a2", _day(31)), ("a", "a3", _day(32)), ("b", "b1", _day(30)), ("c", "c0", _day(40))]
    third = [("d", "d0", _day(80)), ("a", "late", _day(2))]
    for n, rows in enumerate((first, second, third)):
        spark.createDataFrame(rows, "key string, value string, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema("key string, value string, at timestamp").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    _, rows = in_rocks(spark, lambda: written_stream(cached_requests(stream)))
    days = ((F.unix_seconds("at") - F.unix_seconds(F.lit(START))) / 86400).cast("int").alias("day")
    got = sorted(tuple(r) for r in rows.select("key", days, "value", "outcome").collect())
    assert [r for r in got if r[3] != "expired"] == [
        ("a", 0, "a0", "miss"), ("a", 29, "a0", "hit"), ("a", 31, "a2", "miss"), ("a", 32, "a2", "hit"),
        ("b", 0, "b0", "miss"), ("b", 30, "b1", "miss"), ("c", 40, "c0", "miss"), ("d", 80, "d0", "miss")]
    assert {("a", 61, "a2", "expired"), ("b", 60, "b1", "expired"), ("c", 70, "c0", "expired")} <= {r for r in got if r[3] == "expired"}
    assert not [r for r in got if r[0] == "d" and r[3] == "expired"]

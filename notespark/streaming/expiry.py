"""State that ends: a cache whose entries live for a time, as a stateful operator with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import defaults as d
from .jobs import file_stream, written_stream

OUTCOMES = "key string, at timestamp, value string, outcome string"


class ExpiringCache(StatefulProcessor):
    """One entry a key, made by the first request after the last entry's end.  A request before that end is
    a ``hit`` and gets the entry's value; other requests are a ``miss`` and make an entry of their own value.

    Within a batch requests count in the order of time.  A timer at an entry's end removes the state and
    reports it as ``expired`` when the watermark gets there, so that keys which nobody asks for again don't
    stay; whether a request is a hit never depends on when that happens.
    """

    def __init__(self, seconds: int):
        self.milliseconds = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "value string, made long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values(["at", "value"], kind="stable")
        times = rows["at"].astype("datetime64[ms]").astype("int64").tolist()
        held = self.entry.get() if self.entry.exists() else None
        value, made, before = (None, None, None) if held is None else (held[0], held[1], held[1])
        values, outcomes = [], []
        for own, at in zip(rows["value"].tolist(), times, strict=True):
            hit = made is not None and at < made + self.milliseconds
            if not hit:
                value, made = own, at
            values.append(value)
            outcomes.append("hit" if hit else "miss")
        if made != before:
            if before is not None:
                self.handle.deleteTimer(before + self.milliseconds)
            self.entry.update((value, made))
            self.handle.registerTimer(made + self.milliseconds)
        yield pd.DataFrame({"key": key[0], "at": rows["at"].to_numpy(), "value": values, "outcome": outcomes})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        value, made = self.entry.get()
        if made + self.milliseconds <= end:
            self.entry.clear()
            yield pd.DataFrame({"key": [key[0]], "at": [pd.Timestamp(end, unit="ms")], "value": [value], "outcome": ["expired"]})

    def close(self) -> None:
        pass


def cached_requests(requests: DataFrame, seconds: int = d.CACHE_SECONDS, late: str = "1 hour") -> DataFrame:
    """The outcome of every request of a stream (``key``, ``value``, ``at``), and entries that ended.

    Needs the RocksDB state store; requests later than the watermark are dropped, as are keys of null.
    """
    marked = requests.where("key IS NOT NULL").select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "at").withWatermark("at", late)
    grouped = marked.groupBy("key")
    return grouped.transformWithStateInPandas(ExpiringCache(seconds), outputStructType=OUTCOMES, outputMode="Append", timeMode="EventTime")


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_rocks(spark: SparkSession, run):
    """What ``run`` returns, with streams that keep their state in RocksDB."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        return run()
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


#: The first moment of the events, from which a second is made a minute so that they last for years.
BEGIN = 1_704_067_200


def streaming_cache_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests to a cache of thirty days: hits and misses of each user, the time of the last entry,
    and whether it is still held when the stream ends."""
    events = file_stream(spark, sf_dir, "events", "event_id long, ts timestamp_ntz, user_id long")
    at = F.timestamp_seconds(BEGIN + (F.unix_seconds(F.col("ts").cast("timestamp")) - BEGIN) * 60)
    requests = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("value"), at.alias("at"))
    _, rows = in_rocks(spark, lambda: written_stream(cached_requests(requests)))
    n = lambda kind: F.count_if(F.col("outcome") == kind)
    last = lambda kind: F.max(F.when(F.col("outcome") == kind, F.unix_seconds("at")))
    found = rows.groupBy(F.col("key").cast("long").alias("user_id")).agg(
        n("hit").alias("hits"), n("miss").alias("misses"), last("miss").alias("made"), last("expired").alias("_ended"))
    ended = F.coalesce(F.col("_ended") >= F.col("made") + d.CACHE_SECONDS, F.lit(False))
    return found.select("user_id", "hits", "misses", "made", (~ended).alias("held"))

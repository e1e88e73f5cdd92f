"""Keyword search: BM25 over substring matches, all words first, any word otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import defaults as d
from ..functions.text import occurrences, query_tokens


def bm25_scores(fragments: DataFrame, tokens: list[str], key: str = "fragment_id", text: str = "clean_text") -> DataFrame:
    """``key``, ``bm25`` (smaller is better), ``n_matched`` for the fragments that hold any token.

    A token matches as a substring, whatever the case; one under three characters never matches.
    Lengths count trigrams.  The corpus statistics are one aggregate of one row, which is joined
    back by broadcast.
    """
    terms = [t.lower() for t in tokens if len(t) >= 3]
    if not terms:
        return fragments.select(key).where("false").select(key, F.lit(0.0).alias("bm25"), F.lit(0).alias("n_matched"))
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    tf = [occurrences(lowered, t).alias(f"_tf{i}") for i, t in enumerate(terms)]
    length = F.greatest(F.char_length(F.coalesce(F.col(text), F.lit(""))) - 2, F.lit(0)).alias("_length")
    counted = fragments.select(key, length, *tf)
    totals = counted.agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg("_length").alias("_mean"),
        *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))],
    )
    score = F.lit(0.0)
    for i in range(len(terms)):
        df, f = F.col(f"_df{i}"), F.col(f"_tf{i}")
        idf = F.ln((F.col("_n") - df + 0.5) / (df + 0.5))
        idf = F.when(idf > 0, idf).otherwise(F.lit(d.BM25_LEAST_IDF))
        weight = f * (d.BM25_K1 + 1) / (f + d.BM25_K1 * (1 - d.BM25_B + d.BM25_B * F.col("_length") / F.col("_mean")))
        score = score + idf * weight
    matched = sum((F.when(F.col(f"_tf{i}") > 0, 1).otherwise(0) for i in range(len(terms))), F.lit(0))
    joined = counted.where(matched > 0).crossJoin(F.broadcast(totals))
    return joined.select(key, (-score).alias("bm25"), matched.cast("long").alias("n_matched"))


def keyword_search(fragments: DataFrame, query: str, limit: int, key: str = "fragment_id", text: str = "clean_text") -> DataFrame:
    """``key``, ``bm25``, ``rank`` (from 0) of the best ``limit`` fragments.

    Only fragments that hold every token count; if there are none, those that hold any.
    """
    tokens = [t for t in query_tokens(query) if t not in ("AND", "OR", "NOT")]  # an operator alone asks for nothing
    scored = bm25_scores(fragments, tokens, key, text)
    every = F.col("n_matched") == len(tokens)
    # All-word hits sort first, so the best row tells whether there are any.
    best = scored.orderBy(F.desc(every), "bm25", key).limit(limit)
    hits = best.withColumn("_any", F.max(every).over(_everything())).where(every | ~F.col("_any"))
    return hits.select(key, "bm25", (F.row_number().over(_everything().orderBy("bm25", key)) - 1).cast("long").alias("rank"))


def keyword_search_batch(fragments: DataFrame, queries: dict[int, str], limit: int, key: str = "fragment_id", text: str = "clean_text", live: str | None = None) -> DataFrame:
    """``query``, ``key``, ``bm25``, ``rank`` (from 0) of the best ``limit`` fragments of each of a few
    queries, in the same two passes over the fragments however many queries there are.

    ``live`` names a boolean column: fragments without it count in the statistics, but aren't found.
    """
    tokens = {n: [t.lower() for t in query_tokens(q) if t not in ("AND", "OR", "NOT")] for n, q in queries.items()}
    terms = sorted({t for ts in tokens.values() for t in ts if len(t) >= 3})
    kind = fragments.schema[key].dataType.simpleString()
    if not terms:
        return fragments.sparkSession.createDataFrame([], f"query int, {key} {kind}, bm25 double, rank long")
    value = F.coalesce(F.col(text), F.lit(""))
    lowered = F.lower(value)
    tf = [occurrences(lowered, t).alias(f"_tf{i}") for i, t in enumerate(terms)]
    counted = fragments.select(key, F.greatest(F.char_length(value) - 2, F.lit(0)).alias("_length"), (F.col(live) if live else F.lit(True)).alias("_live"), *tf)
    totals = counted.agg(F.count(F.lit(1)).alias("_n"), F.avg("_length").alias("_mean"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))])

    def part(i: int) -> Column:
        df, f = F.col(f"_df{i}"), F.col(f"_tf{i}")
        idf = F.ln((F.col("_n") - df + 0.5) / (df + 0.5))
        return F.when(idf > 0, idf).otherwise(F.lit(d.BM25_LEAST_IDF)) * f * (d.BM25_K1 + 1) / (f + d.BM25_K1 * (1 - d.BM25_B + d.BM25_B * F.col("_length") / F.col("_mean")))

    def scored(n: int) -> Column:
        at = [terms.index(t) for t in tokens[n] if t in terms]
        matched = sum((F.when(F.col(f"_tf{i}") > 0, 1).otherwise(0) for i in at), F.lit(0))
        score = sum((part(i) for i in at), F.lit(0.0))
        return F.struct(F.lit(n).alias("query"), (-score).alias("bm25"), (matched == len(tokens[n])).alias("every"), (matched > 0).alias("any"))

    held = counted.where("_live").crossJoin(F.broadcast(totals))  # one row
    rows = held.select(key, F.inline(F.array(*[scored(n) for n in tokens]))).where(F.col("any"))
    order = Window.partitionBy("query").orderBy(F.desc("every"), "bm25", key)
    best = rows.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= limit)
    hits = best.withColumn("_any", F.max("every").over(Window.partitionBy("query"))).where(F.col("every") | ~F.col("_any"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("bm25", key)) - 1
    return hits.select("query", key, "bm25", rank.cast("long").alias("rank"))


def either(query: str) -> str:
    """The tokens of a query joined by OR."""
    return " OR ".join(query_tokens(query))


#: Trigrams that a snippet shows.
SNIPPET = 32


def snippet(text: Column, query: str, size: int = SNIPPET) -> Column:
    """The window of ``size`` trigrams with the most different words of the query (of equals the first),
    its matches in the middle, every match marked; the text's beginning if there is none.

    Matches come from left to right, longer words first.  The fold over them carries those of the last
    window only, so it is linear in the matches, however long the text.
    """
    words = sorted({t.lower() for t in query_tokens(query)}, key=lambda t: (-len(t), t))
    pattern = "|".join(re.escape(t) for t in words) or "$^"
    lowered = F.lower(text)
    gaps, found = F.split(lowered, pattern), F.regexp_extract_all(lowered, F.lit(f"({pattern})"), 1)
    steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, t: F.struct(F.char_length(g).alias("gap"), t.alias("word")))
    start = F.expr("named_struct('at', 0, 'recent', cast(array() AS array<struct<at: int, end: int, word: string>>), 'score', 0, 'begin', 0, 'end', 0)")
    width = size + 2  # characters of so many trigrams

    def step(a: Column, x: Column) -> Column:
        at = a["at"] + x["gap"]
        end = at + F.char_length(x["word"])
        own = F.struct(at.alias("at"), end.alias("end"), x["word"].alias("word"))
        recent = F.concat(F.filter(a["recent"], lambda r: r["at"] + width >= end), F.array(own))
        score = 1000 * F.size(F.array_distinct(F.transform(recent, lambda r: r["word"]))) + F.size(recent)
        better = score > a["score"]
        pick = lambda new, old: F.when(better, new).otherwise(old)
        return F.struct(end.alias("at"), recent.alias("recent"), pick(score, a["score"]).alias("score"), pick(recent[0]["at"], a["begin"]).alias("begin"), pick(end, a["end"]).alias("end"))

    best = F.aggregate(steps, start, step, lambda a: F.struct(a["begin"].alias("begin"), a["end"].alias("end")))
    length = F.char_length(text)
    begin = F.greatest(F.least(best["begin"] - F.floor((width - (best["end"] - best["begin"])) / 2).cast("int"), length - width), F.lit(0))
    cut = F.substr(text, begin + 1, F.lit(width))
    marked = F.regexp_replace(cut, f"(?iu)({pattern})", "<b>$1</b>") if words else cut
    return F.concat(F.when(begin > 0, "…").otherwise(""), marked, F.when(begin + width < length, "…").otherwise(""))


def _everything():
    """A window over rows that a limit has bounded already."""
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def match_counts(fragments: DataFrame, tokens: list[str], text: str = "clean_text") -> DataFrame:
    """``token`` and the number of fragments that hold it."""
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    counts = fragments.agg(*[F.count_if(F.contains(lowered, F.lit(t))).alias(f"_{i}") for i, t in enumerate(tokens)])
    pairs = F.array(*[F.struct(F.lit(t).alias("token"), F.col(f"_{i}").alias("n")) for i, t in enumerate(tokens)])
    return counts.select(F.inline(pairs))

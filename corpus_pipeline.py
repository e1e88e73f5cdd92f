"""A corpus pipeline of five stages, each of which writes its rows and hands them to the next one.

toxicity            documents that the classifier rejects go
near-dedup          one document of each group of near copies stays (five words, similarity 0.8)
decontamination     documents that leak a benchmark item go
secret scans        secrets are replaced by a mark
mixing              the words that the mix takes of each document

Nulls and other cases: a null text is an empty one; the classifier scores it by its bias, it has no
leaks and no secrets and stays null, and rows without words are near copies of each other, of which
one stays.  Rows without doc_ids and rows that share one are documents of their own unless they are
near copies; decontamination drops them together, as it knows documents by doc_id.  Stages keep all
columns, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notespark.llm import secrets, toxicity
from notespark.llm._labels import remainder
from notespark.llm._shared import _shared_folder, unused
from notespark.llm.decontamination import without_leaks
from notespark.llm.mixing import mix_sources
from notespark.llm.nearcopies import one_of_each


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learnable = F.coalesce(remainder(F.col("doc_id"), 5) != 0, F.lit(False))
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), learnable)
    score = unused(docs, "_score")
    return toxicity.score_toxicity(docs, model, score).where(F.col(score) < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hidden = secrets.redact_secrets(docs, secrets.train(docs))
    return hidden.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secret scans", hide_secrets),
    ("mixing", mix),
]

#: Classifier and components can't be expressed in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; all but the last are written in the checkpoint folder."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{_shared_folder(spark)}/stage-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

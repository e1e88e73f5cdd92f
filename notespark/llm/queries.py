"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality, secrets, toxicity
from ._labels import remainder
from .centroids import cluster_vectors
from .chat import format_conversations, read_back
from .decontamination import find_leaks
from .lexical import ranked_search
from .mixing import mix_sources
from .simhash import simhash_components
from .substrings import remove_repeated_passages
from .tokencounts import count_tokens, load_vocabulary
from .tokenfiles import write_and_verify
from .topk import top_k

#: The vocabularies that op4 counts and op11 encodes with: public tokenizer files, read where they are.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
WORD_TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok").alias("text")
    added = F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")),
                              F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role"))))
    extra = spark.range(1).select(F.lit(-7).alias("conv_id"), added.alias("t")).select("conv_id", "t.turn", "t.role", said)
    found = read_back(format_conversations(turns.unionByName(extra)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return found.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), load_vocabulary(TOKENIZER))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(_table(spark, sf_dir, "documents"), shingle=3)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.select("doc_id", digits, "component_id")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeated_passages(_table(spark, sf_dir, "documents"), length=20)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    model = toxicity.train(docs, labels, ~held_out)
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = quality.train(docs, labels, ~held_out)
    scored = quality.score_quality(docs.select("doc_id", "text"), model)
    predicted = (F.col("score") >= 0.7).cast("int").alias("predicted")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = secrets.find_secrets(docs, secrets.train(docs))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    line = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ","
    )
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(line(base), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
    )


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = Path(WORD_TOKENIZER).read_text(encoding="utf-8")
    return write_and_verify(_table(spark, sf_dir, "documents"), tokenizer, end_id=2)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(_table(spark, sf_dir, "embeddings"), k=8, rounds=10, width=64)


QUERIES = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_mix_sources": op2_mix_sources,
    "op3_format_chats": op3_format_chats,
    "op4_token_counts": op4_token_counts,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_secret_scans": op10_secret_scans,
    "op11_token_files": op11_token_files,
    "op12_ranked_search": op12_ranked_search,
    "op13_centroid_clustering": op13_centroid_clustering,
}

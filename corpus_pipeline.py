"""A training corpus from raw documents: rules, near copies, benchmark leaks, secrets, tokens.

Every stage takes all rows its predecessor kept, with the columns of ``documents``
(others pass through). A null text has no words, so the first stage drops it. Rows
that repeat a doc_id stay or go together in the second and third stage; a row
without a doc_id can't be told from others there and stays. An empty table gives an
empty result in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import byte_bpe, decontaminate, minhash, quality, secret_scan
from shelfspark.llm.graph import lacking, stored
from shelfspark.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a rule rejects."""
    return quality.cascade(docs, out="_rejected_by").where("_rejected_by is null").drop("_rejected_by")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five words, similarity 0.8)."""
    copies = minhash.near_duplicates(docs, minhash.Near()).where("not kept").select("doc_id").distinct()
    return lacking(docs, stored(copies, "copies"), "doc_id").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaking = decontaminate.leaks(docs, benchmark).select("doc_id").distinct()
    return lacking(docs, stored(leaking, "leaking"), "doc_id").select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by a mark; documents stay, their length is counted anew."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else clean


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token_ids and n_tokens, and round_trip: decoding gives the text again."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    names = ["token_ids", "n_tokens", "round_trip"]
    kept = [c for c in docs.columns if c.lower() not in names]
    coded = byte_bpe.encode(docs.select(kept), path, pattern, decoded="_decoded")
    return coded.select(
        *kept,
        "token_ids",
        F.size("token_ids").cast("long").alias("n_tokens"),
        (F.col("_decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: Near copies and tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

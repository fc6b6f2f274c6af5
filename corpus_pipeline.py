"""From raw documents to token ids: five stages, each on what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorleaf.llm import decontaminate, line_dedup, near_duplicates, quality, sentencepiece_viterbi
from mirrorleaf.session import persist_table

PIECES = "piece_bpe_32k.model"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, selects."""
    model = quality.quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.drop_low_quality(docs, model)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more stay in the first of them only; no document goes."""
    columns = docs.columns
    docs = line_dedup.drop_repeated_lines(docs, keep="first")
    if "n_chars" in columns:
        changed = F.col(line_dedup.N_DROPPED) > 0
        docs = docs.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def near_duplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_duplicates.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, and whether they decode to the very text."""
    both = sentencepiece_viterbi.encode_texts(docs, public_tokenizers.path(PIECES), decoded=True)
    exact = F.col("decoded") == F.coalesce("text", F.lit(""))
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids", exact.alias("exact"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", repeated_lines),
    ("near_duplicates", near_duplicate_documents),
    ("decontamination", benchmark_decontamination),
    ("sentencepiece", token_ids),
]

# The fitted classifier and the piece model can't be said in SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each result is a written table, read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = persist_table(spark, stage(spark, docs, sf_dir), name)
    return docs

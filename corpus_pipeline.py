"""A corpus pipeline: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm import decontamination, near_dedup, pieces, pii, quality
from trialspark.llm.hashed_linear import held_out
from trialspark.llm.stored import stored


# Similarity in hundredths from which two documents of the corpus are near duplicates.
NEAR_PERCENT = 80


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labelled part of ``docs``."""
    labels = _table(spark, sf_dir, "labels").where("quality IS NOT NULL")
    marks = labels.select("doc_id", F.col("quality").alias("label"))
    labelled = docs.select("doc_id", "text").join(marks, "doc_id").where(~held_out())
    scored = quality.score(docs, quality.fit(labelled))
    return scored.where(F.col("score") >= quality.THRESHOLD).drop("score")


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.without_near_duplicates(docs, NEAR_PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    return decontamination.without_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def pii_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind and ``n_chars`` brought up to date."""
    clean = pii.masked(docs)
    if "n_chars" in clean.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast("long"))
    return clean


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) and decoded text of each document."""
    vocabulary = pieces.Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.tokenize(docs, vocabulary)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", pii_masking),
    ("sentencepiece", sentencepiece),
]

# Training and merging can't be expressed in SQL. tests/llm holds run() against plain versions of
# the five stages, on planted documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs

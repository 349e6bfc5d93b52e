"""Corpus pipeline: from documents to token counts.

Each stage is a function of (spark, docs, sf_dir).  Its rows are written to the shared folder
and read again as the next one's docs.  Every stage but the last returns the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lapidary.llm import byte_bpe, decontaminate, exact_dedup, jaccard_join, quality
from lapidary.llm.common import table, written

#: Documents that the classifier predicts to be of label 0 go.
REJECT_UNDER = quality.PREDICT_FROM


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model, REJECT_UNDER)


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the least id."""
    return exact_dedup.kept_documents(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates, the one with the least id."""
    return jaccard_join.one_of_each(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With benchmark passages cut out of the texts."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def token_counts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encoded, and decoded again."""
    return byte_bpe.token_digests(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", no_copies),
    ("n-gram Jaccard join", no_near_copies),
    ("benchmark decontamination", no_benchmark),
    ("byte-level BPE", token_counts),
]

#: Trained models and byte-pair merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs

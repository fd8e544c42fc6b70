"""Cleaning of a corpus in five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

A stage's result is written as Parquet and read back as the next one's docs. All
but the last return the columns of documents, whatever their names. A row counts by its
doc_id and text: of rows with both equal one stays from the exact dedup on. Null texts
count as empty ones, null ids are ids like any other, and an empty table passes through
all stages as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deploy_analytics.llm import exact_dedup, near_dedup, packing, secret_scan, store
from deploy_analytics.llm import toxicity as toxicity_op


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, doesn't call toxic.

    Null and empty texts get the score of an empty text; equal texts stay or go
    together. Without labels of both kinds all documents stay.
    """
    return toxicity_op.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z in lower case) the document with the largest doc_id; null is the least, and null texts equal empty ones."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least doc_id; null comes last. Texts without a word are alike only if equal."""
    return near_dedup.drop_near_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mask; null texts become empty."""
    return secret_scan.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, each with its sequence and its place there; an empty text is one piece, the end."""
    import public_tokenizers

    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("secret_scan", secrets), ("best_fit_packing", pack)]

#: No SQL expresses the classifier, the near copies or the packing; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = store.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

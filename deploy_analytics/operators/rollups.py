"""Deduplicated deployments and additive counts over them.

Counts are additive: a batch appends partial counts, a removed source appends
negative ones, and readers sum. So no table needs an update in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["chain_id", "block_number", "create_index", "contract_address"]
BUCKET_BLOCKS = 10_000


def complete(rows: DataFrame) -> DataFrame:
    """Rows that have a block and an address."""
    return rows.filter("block_number is not null and contract_address is not null")


def dedup_batch(rows: DataFrame) -> DataFrame:
    """One row per deployment; each other column keeps its least non-null value."""
    return complete(rows).groupBy(*KEY).agg(*(F.min(c).alias(c) for c in rows.columns if c not in KEY))


def bucket(width: int = BUCKET_BLOCKS, block: str = "block_number"):
    return F.expr(f"{block} div {width}")


def new_rows(batch: DataFrame, stored: DataFrame, width: int = BUCKET_BLOCKS) -> DataFrame:
    """Deduplicated rows of batch that stored lacks.

    stored is cut to the batch's span of blocks first, a filter that reaches the
    scan (and the partitions, where it is partitioned by block_bucket).
    """
    batch = dedup_batch(batch)
    low, high = batch.agg(F.min("block_number"), F.max("block_number")).first()
    if low is None:
        return batch
    near = stored.filter(F.col("block_number").between(low, high))
    if "block_bucket" in stored.columns:
        near = near.filter(F.col("block_bucket").between(low // width, high // width))
    return batch.join(near.select(*KEY), KEY, "left_anti")


def block_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("chain_id", "block_number").agg(F.count("*").alias("contract_count"))


def code_counts(rows: DataFrame) -> DataFrame:
    return rows.filter("code_hash is not null").groupBy("chain_id", "code_hash").agg(F.count("*").alias("contract_count"), F.max("n_code_bytes").alias("n_code_bytes"))


def bucket_code_counts(rows: DataFrame, width: int = BUCKET_BLOCKS) -> DataFrame:
    coded = rows.filter("code_hash is not null")
    return coded.groupBy("chain_id", bucket(width).alias("block_bucket"), "code_hash").agg(F.count("*").alias("contract_count"), F.max("n_code_bytes").alias("n_code_bytes"))


def negated(counts: DataFrame) -> DataFrame:
    """The partial counts that take a source's share away again."""
    return counts.withColumn("contract_count", -F.col("contract_count"))


def summed(counts: DataFrame) -> DataFrame:
    """Counts from all partial ones; keys whose count fell to zero are gone."""
    return partials(counts).filter("contract_count > 0")


def partials(counts: DataFrame) -> DataFrame:
    """Some partial counts added up. Negative ones stay, for others to meet them; those that met theirs are gone."""
    keys = [c for c in counts.columns if c not in ("contract_count", "n_code_bytes")]
    sizes = [F.max("n_code_bytes").alias("n_code_bytes")] if "n_code_bytes" in counts.columns else []
    return counts.groupBy(*keys).agg(F.sum("contract_count").alias("contract_count"), *sizes).filter("contract_count <> 0")


def untracked(sources: DataFrame, manifest: DataFrame) -> DataFrame:
    """Listed sources that no earlier run ingested."""
    return sources.join(manifest.select("source_path"), "source_path", "left_anti")


def vanished(sources: DataFrame, manifest: DataFrame) -> DataFrame:
    """Ingested sources that are no longer listed; any such calls for a rebuild."""
    return manifest.join(sources.select("source_path"), "source_path", "left_anti")


def without_source(rows: DataFrame, source: str) -> DataFrame:
    """Deployments that remain once a source is invalidated: those another source still has."""
    return dedup_batch(rows.filter(F.col("source_path") != source))


def snapshot_deployments(contracts: DataFrame, bytecodes: DataFrame) -> DataFrame:
    """Deployments from a normalized snapshot: code and size by hash, no deployer."""
    sized = bytecodes.select(F.col("code_hash").alias("bytecode_hash"), F.col("n_code_bytes"))
    joined = contracts.join(sized, "bytecode_hash", "left")
    return joined.select(
        F.coalesce("chain_id", F.lit(1)).cast("long").alias("chain_id"), "block_number", "create_index", "contract_address",
        F.lit(None).cast(contracts.schema["contract_address"].dataType).alias("deployer"), F.col("bytecode_hash").alias("code_hash"), "n_code_bytes",
    )


def source_span(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source_path").agg(F.min("block_number").alias("start_block"), F.max("block_number").alias("end_block"), F.count("*").alias("rows"))


def indexed_range(counts: DataFrame) -> DataFrame:
    return counts.groupBy("chain_id").agg(F.min("block_number").alias("first_block"), F.max("block_number").alias("last_block"))


def highest_covered(counts: DataFrame, file_ends: DataFrame) -> DataFrame:
    """Per chain the highest block that rows or a file's name cover."""
    return (
        indexed_range(counts)
        .join(file_ends.groupBy("chain_id").agg(F.max("end_block").alias("file_end")), "chain_id", "full")
        .select("chain_id", F.col("last_block").alias("highest_indexed"), F.greatest("last_block", "file_end").alias("highest_covered"))
    )

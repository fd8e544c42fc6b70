"""Aggregates of the dashboard, answered from counts; functions take and return DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocktime, rollups

# The bins of runtime code sizes, in order, with the largest size of each.
BINS = [
    ("0 B", 0), ("1-32 B", 32), ("33-44 B", 44), ("45 B minimal proxy", 45), ("45 B other", 45), ("46-64 B", 64), ("65-256 B", 256),
    ("257 B-1 KB", 1024), ("1-4 KB", 4096), ("4-8 KB", 8192), ("8-16 KB", 16384), ("16-24 KB", 24576),
]
CHAINS = [(1, "Ethereum", True), (100, "Gnosis", False)]


def in_range(df: DataFrame, block_range, column: str = "block_number") -> DataFrame:
    return df if block_range is None else df.filter(F.col(column).between(*block_range))


def verified_deployments(deployments: DataFrame, labels: DataFrame) -> DataFrame:
    """Deployments whose address has a positive label; repeated labels don't repeat them."""
    return deployments.join(labels.filter("is_verified").select("chain_id", "contract_address"), ["chain_id", "contract_address"], "left_semi")


def stats(counts: DataFrame, deployments: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per chain: totals, verified share in per cent, first and last block, coverage (0 or 100)."""
    totals = counts.groupBy("chain_id").agg(F.sum("contract_count").alias("total_contracts"), F.min("block_number").alias("first_block"), F.max("block_number").alias("last_block"))
    verified = verified_deployments(deployments, labels).groupBy("chain_id").agg(F.count("*").alias("v"))
    rows = totals.join(verified, "chain_id", "left").withColumn("verified_count", F.expr("least(coalesce(v, 0), total_contracts)"))
    return rows.select(
        "chain_id", "total_contracts", "verified_count", F.expr("total_contracts - verified_count").alias("unverified_count"),
        F.expr("if(total_contracts = 0, 0D, 100.0D * verified_count / total_contracts)").alias("verified_pct"), "first_block", "last_block",
        F.expr("if(total_contracts = 0, 0D, 100.0D)").alias("enrichment_coverage_pct"),
    )


def _bounds(width: int):
    return [F.expr(f"bucket_id * {width}").alias("block_start"), F.expr(f"bucket_id * {width} + {width} - 1").alias("block_end")]


def deploys_over_time(counts: DataFrame, checkpoints: DataFrame, chain: int, width: int, block_range=None) -> DataFrame:
    """(block_start, block_end, time of the middle block, count) per bucket; edges aren't clipped to the range."""
    width = max(1, width)
    rows = in_range(counts.filter(F.col("chain_id") == chain), block_range).groupBy(rollups.bucket(width).alias("bucket_id")).agg(F.sum("contract_count").alias("count"))
    rows = rows.select(F.lit(chain).cast("long").alias("chain_id"), *_bounds(width), F.expr(f"bucket_id * {width} + {width // 2}").alias("mid"), "count")
    return blocktime.block_times(rows, checkpoints, "mid", "time").select("block_start", "block_end", "time", "count")


def verified_ratio_over_time(counts: DataFrame, deployments: DataFrame, labels: DataFrame, chain: int, width: int, block_range=None) -> DataFrame:
    """(block_start, block_end, verified, unverified, unknown) per bucket; unknown is always 0."""
    width = max(1, width)
    at = rollups.bucket(width).alias("bucket_id")
    totals = in_range(counts.filter(F.col("chain_id") == chain), block_range).groupBy(at).agg(F.sum("contract_count").alias("total"))
    checked = verified_deployments(in_range(deployments.filter(F.col("chain_id") == chain), block_range), labels).groupBy(at).agg(F.count("*").alias("v"))
    rows = totals.join(checked, "bucket_id", "left").withColumn("verified", F.expr("least(coalesce(v, 0), total)"))
    return rows.select(*_bounds(width), "verified", F.expr("greatest(total - verified, 0)").alias("unverified"), F.lit(0).cast("long").alias("unknown"))


def code_counts_in(codes: DataFrame, bucket_codes: DataFrame, deployments: DataFrame, chain: int, block_range=None, width: int = rollups.BUCKET_BLOCKS) -> DataFrame:
    """(code_hash, contract_count, n_code_bytes), one row a hash: whole buckets from their counts, edges from deployments."""
    columns = ["code_hash", "contract_count", "n_code_bytes"]
    if block_range is None:
        return codes.filter(F.col("chain_id") == chain).select(*columns)
    s, e = block_range
    first, end = -(-s // width), (e + 1) // width

    def edge(a, b):
        return rollups.code_counts(deployments.filter((F.col("chain_id") == chain) & F.col("block_number").between(a, b))).select(*columns)

    if first >= end:
        return edge(s, e)
    parts = [bucket_codes.filter((F.col("chain_id") == chain) & F.col("block_bucket").between(first, end - 1)).select(*columns)]
    if s < first * width:
        parts.append(edge(s, first * width - 1))
    if e >= end * width:
        parts.append(edge(end * width, e))
    every = reduce(DataFrame.unionByName, parts).groupBy("code_hash")
    return every.agg(F.sum("contract_count").alias("contract_count"), F.max("n_code_bytes").alias("n_code_bytes"))


def bytecode_size_distribution(counts: DataFrame, meta: DataFrame) -> DataFrame:
    """(position, label, count) of twelve bins, empty ones too; unknown sizes and those over 24,576 bytes are left out."""
    cases = " ".join(
        f"when n_code_bytes = 45 and {'' if 'minimal' in label else 'not '}coalesce(is_proxy_minimal, false) then {i}" if size == 45 else f"when n_code_bytes <= {size} then {i}"
        for i, (label, size) in enumerate(BINS)
    )
    sized = counts.filter(f"n_code_bytes is not null and n_code_bytes <= {BINS[-1][1]}").join(meta.select("code_hash", "is_proxy_minimal"), "code_hash", "left")
    found = sized.groupBy(F.expr(f"case {cases} end").alias("position")).agg(F.sum("contract_count").alias("n"))
    bins = counts.sparkSession.createDataFrame([(i, label) for i, (label, _) in enumerate(BINS)], "position int, label string")
    return bins.join(found, "position", "left").select("position", "label", F.coalesce("n", F.lit(0).cast("long")).alias("count"))


def top_compilers(counts: DataFrame, meta: DataFrame, n: int = 10) -> DataFrame:
    """The n (1 to 50) compiler versions with most contracts; ties by version."""
    known = meta.filter("compiler_version is not null").select("code_hash", "compiler_version")
    rows = counts.join(known, "code_hash").groupBy("compiler_version").agg(F.sum("contract_count").alias("count"))
    return rows.orderBy(F.desc("count"), "compiler_version").limit(min(max(n, 1), 50))


def compiler_version_total(counts: DataFrame, meta: DataFrame) -> DataFrame:
    rows = counts.join(meta.filter("compiler_version is not null").select("code_hash"), "code_hash")
    return rows.agg(F.coalesce(F.sum("contract_count"), F.lit(0)).alias("total"))


def language_distribution(counts: DataFrame, meta: DataFrame) -> DataFrame:
    rows = counts.join(meta.select("code_hash", "language"), "code_hash", "left")
    return rows.groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.sum("contract_count").alias("count")).orderBy(F.desc("count"), "language")


FLAGS = ["is_erc20", "is_erc721", "is_erc1155", "is_proxy_eip1967", "is_proxy_minimal", "uses_push0", "has_source_hash"]


def standards_breakdown(counts: DataFrame, meta: DataFrame) -> DataFrame:
    rows = counts.join(meta.select("code_hash", *FLAGS), "code_hash")
    total = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("contract_count")).otherwise(0)), F.lit(0)).alias(c)
    return rows.agg(*map(total, FLAGS), F.coalesce(F.sum("contract_count"), F.lit(0)).alias("total_decoded"))


def recent(deployments: DataFrame, counts: DataFrame, chain: int, n: int = 20, cursor=None) -> DataFrame:
    """The newest n (1 to 200) deployments before a cursor (block, create_index), and one more if there are any.

    The block counts say how far down the page can reach, so the scan is bounded.
    """
    n = min(max(n, 1), 200)
    rows, heads = deployments.filter(F.col("chain_id") == chain), counts.filter(F.col("chain_id") == chain)
    if cursor is not None:
        block, index = cursor
        rows = rows.filter((F.col("block_number") < block) | ((F.col("block_number") == block) & (F.col("create_index") < index)))
        heads = heads.filter(F.col("block_number") < block)
    # n + 1 blocks with a contract each hold the page
    lowest = heads.orderBy(F.desc("block_number")).limit(n + 1).agg(F.min("block_number"), F.count("*")).first()
    if lowest[1] == n + 1:
        rows = rows.filter(F.col("block_number") >= lowest[0])
    return rows.orderBy(F.desc("block_number"), F.desc("create_index"), "contract_address").limit(n + 1)


def decorated(page: DataFrame, labels: DataFrame, meta: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """A page (at most 201 rows, broadcast) with verification, compiler and time."""
    page_b = F.broadcast(page)
    checked = labels.join(page_b.select("chain_id", "contract_address").distinct(), ["chain_id", "contract_address"], "left_semi").groupBy("chain_id", "contract_address").agg(F.expr("bool_or(is_verified)").alias("v"))
    coded = meta.join(page_b.select("code_hash").distinct(), "code_hash", "left_semi").groupBy("code_hash").agg(F.max("language").alias("language"), F.max("compiler_version").alias("compiler_version"))
    rows = page.join(checked, ["chain_id", "contract_address"], "left").join(coded, "code_hash", "left")
    timed = blocktime.block_times(rows, checkpoints, "block_number", "time")
    return timed.withColumn("is_verified", F.coalesce("v", F.lit(False))).drop("v")


def chains(spark) -> DataFrame:
    return spark.createDataFrame(CHAINS, "chain_id long, name string, is_default boolean")

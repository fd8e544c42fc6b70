"""CSV exports: unique bytecodes and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hexes import from_hex, unprefixed

BYTECODES, CONTRACTS = "bytecode_hash string, bytecode string", "address string, bytecode_hash string, blocknum long"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def bytecodes(rows: DataFrame) -> DataFrame:
    """(code_hash, code, n_code_bytes) once per well-formed 32-byte hash; the size is that of the text's digits."""
    code = unprefixed(F.coalesce("bytecode", F.lit("")))
    fits = F.length("bytecode_hash") == 66
    found = rows.filter(fits).select(F.unhex(F.substring("bytecode_hash", 3, 64)).alias("code_hash"), F.unhex(code).alias("code"), F.length(code).alias("_n"))
    return found.filter("code_hash is not null").groupBy("code_hash").agg(F.min("code").alias("code"), F.min(F.expr("_n div 2")).alias("n_code_bytes"))


def contracts(rows: DataFrame, chain: int = 1) -> DataFrame:
    """Contracts with well-formed addresses, numbered in their block by address; malformed hashes become null. Newest first in each partition."""
    w = Window.partitionBy("block_number").orderBy("contract_address")
    fits = rows.filter(F.length("address") == 42)
    out = fits.select(
        from_hex(F.col("address"), 40).alias("contract_address"), from_hex(F.when(F.length("bytecode_hash") == 66, F.col("bytecode_hash")), 64).alias("bytecode_hash"),
        F.col("blocknum").alias("block_number"), F.lit(chain).cast("long").alias("chain_id"),
    )
    out = out.filter("contract_address is not null").withColumn("create_index", (F.row_number().over(w) - 1).cast("long"))
    return out.sortWithinPartitions(F.desc("block_number"), F.desc("create_index"))


def summaries(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contracts per hash, and per block."""
    by_hash = rows.filter("bytecode_hash is not null").groupBy("bytecode_hash").agg(F.count("*").alias("contract_count"))
    return by_hash, rows.groupBy("block_number").agg(F.count("*").alias("contract_count"))

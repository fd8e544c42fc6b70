"""Contract files: listing, tolerant reading, and what file names say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABEL_FILE = "enrichment.parquet"


def list_files(spark: SparkSession, folder: str, glob: str = "*.parquet") -> DataFrame:
    """(path, name, length, modificationTime) of data files; file contents aren't read. Hidden files are skipped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    named = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "modificationTime")
    return named.filter((F.col("name") != LABEL_FILE) & ~F.col("name").rlike("^[._]"))


def read_union(spark: SparkSession, folder: str, glob: str = "*.parquet") -> DataFrame:
    """All rows of a folder, columns united by name, with the file each row is from."""
    rows = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).parquet(folder)
    return rows.withColumn("source_path", F.col("_metadata.file_name")).filter(F.col("source_path") != LABEL_FILE)


def normalized(rows: DataFrame, *more: str | None) -> DataFrame:
    """rows with the columns that ingestion needs, and more of their own; absent ones get defaults.

    block_number and contract_address are required. The size falls back to that of
    the code, the chain to 1.
    """
    missing = {"block_number", "contract_address"} - set(rows.columns)
    if missing:
        raise ValueError(f"required columns are missing: {sorted(missing)}")
    have = set(rows.columns)
    column = lambda c, kind, default=None: (F.coalesce(F.col(c).cast(kind), F.lit(default).cast(kind)) if c in have else F.lit(default).cast(kind)).alias(c)
    size = F.col("n_code_bytes").cast("long") if "n_code_bytes" in have else F.lit(None).cast("long")
    if "code" in have:
        size = F.coalesce(size, F.octet_length("code").cast("long"))
    address = rows.schema["contract_address"].dataType.simpleString()
    return rows.select(
        column("chain_id", "long", 1), F.col("block_number").cast("long"), column("create_index", "long", 0), "contract_address",
        column("deployer", address), column("code_hash", address if "code_hash" not in have else rows.schema["code_hash"].dataType.simpleString()),
        size.alias("n_code_bytes"), *(c for c in ("source_path", *more) if c in have),
    )


def file_spans(files: DataFrame) -> DataFrame:
    """files (name) with chain_id (legacy names: 1), start_block, end_block by the numbers in the name; others are left out."""
    numbers = F.transform(F.regexp_extract_all("name", F.lit(r"(\d+)")), lambda x: x.cast("long"))
    rows = files.withColumn("_n", numbers)
    legacy = ~F.col("name").contains("__chain_")
    rows = rows.filter((F.size("_n") >= 3) | (legacy & (F.size("_n") >= 2)))
    chain = F.when(legacy, F.lit(1).cast("long")).otherwise(F.element_at("_n", 1))
    return rows.select(*files.columns, chain.alias("chain_id"), F.element_at("_n", -2).alias("start_block"), F.element_at("_n", -1).alias("end_block"))

"""Landed files of traces, block headers and registry exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def traces(spark: SparkSession, path: str) -> DataFrame:
    """(chain_id, block_number, pos, trace) of lines that hold a block's traces in order."""
    return spark.read.schema(schemas.TRACE_LINES).json(path).select("chain_id", "block_number", F.posexplode("traces").alias("pos", "trace"))


def block_headers(spark: SparkSession, path: str) -> DataFrame:
    """(chain_id, block_number, block_timestamp): the hex quantity as epoch seconds."""
    rows = spark.read.schema(schemas.HEADER_LINES).json(path)
    return rows.select("chain_id", "block_number", F.conv(F.substring("timestamp", 3, 16), 16, 10).cast("long").alias("block_timestamp"))


def registry(spark: SparkSession, folder: str, table: str, schema: str) -> DataFrame:
    """A table of an export, several files, with the file that each row is from."""
    rows = spark.read.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{folder}/{table}")
    return rows.withColumn("file", F.col("_metadata.file_path"))

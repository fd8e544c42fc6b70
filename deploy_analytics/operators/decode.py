"""The decode job: bytecode analysed once per distinct hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bytecode

MOST = 65_536  #: bytes of code that are analysed
FLAGS = ["has_source_hash", "is_erc20", "is_erc721", "is_erc1155", "is_proxy_eip1967", "is_proxy_minimal", "uses_push0"]
FOUND = ["language", "compiler_version", *FLAGS]


def eligible(rows: DataFrame) -> DataFrame:
    """Rows with an address of 20 bytes and 1 to 65,536 bytes of code, as many as stated where n_code_bytes exists."""
    size = F.octet_length("code")
    fits = (F.octet_length("contract_address") == 20) & size.between(1, MOST)
    if "n_code_bytes" in rows.columns:
        fits &= F.col("n_code_bytes") == size
    return rows.filter(fits)


def pending(codes: DataFrame, known: DataFrame) -> DataFrame:
    """One row per code hash that has code of 1 to 65,536 bytes and no metadata yet."""
    fresh = codes.filter(F.octet_length("code").between(1, MOST)).join(known.select("code_hash"), "code_hash", "left_anti")
    return fresh.groupBy("code_hash").agg(F.min("code").alias("code"))


def decode_hashes(codes: DataFrame, known: DataFrame, as_of: str) -> DataFrame:
    """Metadata of pending hashes."""
    rows = bytecode.analyzed(pending(codes, known))
    return rows.select("code_hash", *FOUND, F.lit(as_of).cast("timestamp").alias("decoded_at"))


def decode_live(rows: DataFrame, known: DataFrame, as_of: str) -> DataFrame:
    """Metadata of hashes that a batch of new deployments brings and that no earlier one had; hashes have 32 bytes."""
    return decode_hashes(rows.filter(F.octet_length("code_hash") == 32), known, as_of)


def decode_addresses(rows: DataFrame, by_hash: DataFrame, source: str) -> DataFrame:
    """Metadata per address of eligible rows of a source file, from that of their hashes."""
    found = by_hash.select("code_hash", *FOUND)
    return eligible(rows).select("chain_id", "contract_address", "code_hash").distinct().join(found, "code_hash").withColumn("source_file", F.lit(source))


def file_addresses(rows: DataFrame, by_hash: DataFrame) -> DataFrame:
    """(path, chain_id, contract_address, code_hash) and metadata of eligible rows of contract files, each address once a file."""
    found = by_hash.select("code_hash", *FOUND)
    return eligible(rows).select("path", "chain_id", "contract_address", "code_hash").distinct().join(found, "code_hash")


def unfinished(files: DataFrame, completed: DataFrame) -> DataFrame:
    """Files (path, length, modificationTime) not completed with the same size and time."""
    return files.join(completed, ["path", "length", "modificationTime"], "left_anti")


def current_by_hash(rows: DataFrame) -> DataFrame:
    """The row decoded last for each hash; rows without a time come after all others, ties by version."""
    w = Window.partitionBy("code_hash").orderBy(F.desc_nulls_last("decoded_at"), F.asc_nulls_last("compiler_version"))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def addresses_across_generations(new: DataFrame, old: DataFrame) -> DataFrame:
    """New rows, and old ones of addresses that have none; columns that the old generation lacks are null, flags false."""
    rest = old.join(new.select("chain_id", "contract_address"), ["chain_id", "contract_address"], "left_anti")
    both = new.unionByName(rest, allowMissingColumns=True)
    return both.fillna(False, [f for f in FLAGS if f in both.columns])

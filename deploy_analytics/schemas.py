"""Fixed schemas. Nothing is inferred; readers pad what older files lack."""

from __future__ import annotations

from pyspark.sql import types as T

_NUMBER = {"block_number", "create_index", "n_init_code_bytes", "n_code_bytes", "chain_id"}
_COLUMNS = [
    "block_number", "block_hash", "create_index", "transaction_hash", "contract_address", "deployer", "factory", "init_code", "code",
    "init_code_hash", "n_init_code_bytes", "n_code_bytes", "code_hash", "chain_id",
]

#: The canonical deployment row.
DEPLOYMENT = T.StructType([T.StructField(c, T.LongType() if c in _NUMBER else T.BinaryType()) for c in _COLUMNS])

#: The same row in contract files. Chains may be unsigned 64-bit numbers there, which Parquet readers give as decimals.
CONTRACT_FILE = T.StructType([T.StructField(f.name, T.DecimalType(20, 0)) if f.name == "chain_id" else f for f in DEPLOYMENT])

#: A landed file of traces: one line per block.
TRACE = """struct<type: string, action: struct<from: string, author: string, refundAddress: string, rewardType: string, init: string>,
 result: struct<address: string, code: string>, traceAddress: array<int>, blockHash: string, transactionHash: string>"""
TRACE_LINES = f"chain_id long, block_number long, traces array<{TRACE}>"
HEADER_LINES = "chain_id long, block_number long, timestamp string"

#: Tables of the follower; kind is the type of addresses and hashes.
BLOCK_COUNTS = "chain_id long, block_number long, contract_count long"
HEADS = "chain_id long, head long"
SOURCES = "source_path string, block_part long, start_block long, end_block long, rows long, live long"
CHECKPOINTS = "chain_id long, block_number long, block_timestamp long, observed_at long"
REMOVED = "source_path string, upto long"


def stored(kind: str) -> str:
    return f"chain_id long, block_number long, create_index long, contract_address {kind}, deployer {kind}, code_hash {kind}, n_code_bytes long, source_path string"


def code_counts(kind: str) -> str:
    return f"chain_id long, code_hash {kind}, contract_count long, n_code_bytes long"


def bucket_code_counts(kind: str) -> str:
    return f"chain_id long, block_bucket long, code_hash {kind}, contract_count long, n_code_bytes long"


def metadata(kind: str) -> str:
    flags = "".join(f", {f} boolean" for f in ("has_source_hash", "is_erc20", "is_erc721", "is_erc1155", "is_proxy_eip1967", "is_proxy_minimal", "uses_push0"))
    return f"code_hash {kind}, language string, compiler_version string{flags}, decoded_at timestamp"


def labels(kind: str) -> str:
    return f"chain_id long, contract_address {kind}, is_verified boolean, contract_name string, verification_source string, match_type string, checked_at timestamp, block_number long, create_index long"

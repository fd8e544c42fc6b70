"""Traces of blocks to contract deployments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hexes import from_hex
from ..functions.keccak import keccak256

ZERO_ADDRESS = "0x" + "0" * 40
MOST_BLOCK = 2**32 - 1
SENDER = """case when size(trace.traceAddress) = 0 then
    case trace.type when 'suicide' then trace.action.refundAddress when 'selfdestruct' then trace.action.refundAddress
                    when 'reward' then trace.action.author else trace.action.from end end"""
MADE = "trace.type = 'create' and trace.result.address is not null"
BLOCK = f"if(block_number > {MOST_BLOCK}, cast(raise_error(concat('block number overflows: ', block_number)) as bigint), block_number)"
BLOCK_HASH = "if(trace.blockHash is null, raise_error('missing block hash in trace'), trace.blockHash)"
#: Columns of a deployment that are fields of its trace.
FIELDS = {
    "block_hash": BLOCK_HASH, "transaction_hash": "trace.transactionHash", "contract_address": "trace.result.address",
    "factory": "trace.action.from", "init_code": "trace.action.init", "code": "trace.result.code",
}


def without_rewards(traces: DataFrame) -> DataFrame:
    return traces.filter("not (coalesce(trace.type = 'reward', false) or trace.action.rewardType is not null)")


def _root_caller(sender):
    w = Window.partitionBy("chain_id", "block_number").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(sender, ignorenulls=True).over(w), F.lit(ZERO_ADDRESS))


def with_root_caller(traces: DataFrame) -> DataFrame:
    """traces with deployer: who sent the last trace at the root of the tree, per block; zero before any."""
    return traces.withColumn("deployer", _root_caller(F.expr(SENDER)))


def successful_creates(traces: DataFrame) -> DataFrame:
    return traces.filter(MADE)


def with_create_index(creates: DataFrame) -> DataFrame:
    """creates numbered from 0 in their block."""
    w = Window.partitionBy("chain_id", "block_number").orderBy("pos")
    return creates.withColumn("create_index", F.row_number().over(w) - 1)


def checked(creates: DataFrame) -> DataFrame:
    """creates, failing the job on a block number beyond 32 bits or without a block hash."""
    return creates.withColumns({"block_number": F.expr(BLOCK), "block_hash": F.expr(BLOCK_HASH)})


def deployments(traces: DataFrame, hashes: bool = True) -> DataFrame:
    """The canonical deployment rows of blocks' traces, with hashes of both codes unless told otherwise.

    Of a trace that makes nothing only its sender is shuffled, of the others the fields that a row has, as bytes.
    """
    made = F.coalesce(F.expr(MADE), F.lit(False))
    cut = without_rewards(traces).select("chain_id", "block_number", "pos", F.expr(SENDER).alias("sender"), made.alias("made"), *(F.when(made, from_hex(F.expr(e))).alias(c) for c, e in FIELDS.items()))
    rows = with_create_index(cut.withColumn("deployer", _root_caller(F.col("sender"))).filter("made"))
    rows = rows.select(
        F.expr(BLOCK).alias("block_number"), "block_hash", "create_index", "transaction_hash", "contract_address", from_hex(F.col("deployer")).alias("deployer"), "factory", "init_code", "code", "chain_id",
    )
    rows = rows.withColumns({"n_init_code_bytes": F.octet_length("init_code"), "n_code_bytes": F.octet_length("code")})
    if hashes:
        rows = rows.withColumns({"init_code_hash": keccak256(F.col("init_code")), "code_hash": keccak256(F.col("code"))})
    return rows

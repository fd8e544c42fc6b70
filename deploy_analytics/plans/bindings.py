"""The domain tables, derived from the driver's star schema, and the same derivations as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 1000  #: blocks of a bucket; the production default is rollups.BUCKET_BLOCKS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping sources, a and b, with repeated rows."""
    item = table(spark, sf_dir, "lineitem").select(
        F.expr("if(l_orderkey % 5 = 0, 100L, 1L)").alias("chain_id"),
        F.col("l_orderkey").alias("block_number"),
        F.col("l_linenumber").cast("long").alias("create_index"),
        F.col("l_suppkey").alias("contract_address"),
        (F.col("l_orderkey") % 97).alias("deployer"),
        F.col("l_partkey").alias("code_hash"),
        F.expr("case when l_partkey % 7 = 0 then 45L when l_partkey % 11 = 0 then 0L else (l_partkey * 37) % 26000 end").alias("n_code_bytes"),
    )
    one = item.filter("create_index <= 4").withColumn("source_path", F.lit("a"))
    return one.unionByName(item.filter("create_index >= 3").withColumn("source_path", F.lit("b")))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What decoding found, by code hash; a fifth of the hashes has none."""
    return table(spark, sf_dir, "part").filter("p_partkey % 10 < 8").select(
        F.col("p_partkey").alias("code_hash"),
        F.expr("case when p_type in ('ECONOMY', 'STANDARD') then 'solidity' when p_type = 'PROMO' then 'vyper' end").alias("language"),
        F.expr("if(p_partkey % 9 = 0, null, p_brand)").alias("compiler_version"),
        F.expr("p_size % 2 = 0").alias("has_source_hash"),
        F.expr("p_partkey % 3 = 0").alias("is_erc20"),
        F.expr("p_partkey % 5 = 0").alias("is_erc721"),
        F.expr("p_partkey % 15 = 1").alias("is_erc1155"),
        F.expr("p_partkey % 13 = 0").alias("is_proxy_eip1967"),
        F.expr("p_partkey % 14 = 0").alias("is_proxy_minimal"),
        F.expr("p_size > 25").alias("uses_push0"),
        F.expr("cast(p_size as bigint)").alias("decoded_at"),
    )


def metadata_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata with an older row, or one without a time, for some hashes."""
    new = metadata(spark, sf_dir)
    old = new.filter("code_hash % 4 = 0").withColumn("compiler_version", F.lit("old"))
    return new.unionByName(old.withColumn("decoded_at", F.expr("if(code_hash % 8 = 0, null, decoded_at - 1)")))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verification labels on both chains; a third of them twice."""
    one = table(spark, sf_dir, "supplier").select(
        F.explode(F.array(F.lit(1).cast("long"), F.lit(100).cast("long"))).alias("chain_id"),
        F.col("s_suppkey").alias("contract_address"),
        F.expr("s_acctbal > 5000").alias("is_verified"),
        F.col("s_name").alias("contract_name"),
        F.expr("if(s_nationkey % 2 = 0, 'runtime', 'metadata')").alias("match_type"),
        F.expr("if(s_suppkey % 10 = 3, null, s_suppkey * 37 + 900)").alias("block_number"),
    )
    return one.unionByName(one.filter("contract_address % 3 = 0"))


def registry_deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.expr("if(o_orderkey % 5 = 0, 100L, 1L)").alias("chain_id"),
        F.expr("if(o_orderkey % 17 = 0, null, o_custkey)").alias("address"),
        F.expr("if(o_orderkey % 11 = 0, -1L, o_orderkey * 2)").alias("block_number"),
        F.expr("if(o_orderkey % 13 = 0, -1L, o_custkey % 7)").alias("transaction_index"),
        F.concat(F.lit("contract_deployments_"), (F.col("o_orderkey") % 3).cast("string")).alias("file"),
    )


def registry_verifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("deployment_id"),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("created_at"),
        F.expr("l_returnflag = 'A'").alias("runtime_match"),
        F.expr("l_linestatus = 'F' and l_linenumber > 2").alias("creation_match"),
        F.expr("if(l_quantity > 40, null, l_returnflag = 'N')").alias("runtime_metadata_match"),
        F.expr("l_linestatus = 'O' and l_quantity > 25").alias("creation_metadata_match"),
        F.concat(F.lit("verified_contracts_"), F.col("l_linenumber").cast("string")).alias("file"),
    )


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block times known exactly: every 500th event."""
    return table(spark, sf_dir, "events").filter("event_id % 500 = 0").select(
        F.lit(1).cast("long").alias("chain_id"), F.col("event_id").alias("block_number"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("block_timestamp")
    )


def bytecodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as code. Letters from ` to z are PUSH opcodes, so a walk over them is well exercised."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("code_hash"), F.encode("text", "UTF-8").alias("code"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of blocks in order: chain_id, block_number, pos, trace."""
    item = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as block_number", "if(l_orderkey % 5 = 0, 100L, 1L) as chain_id", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity",
        "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 as pos",
    )
    hexed = "concat('0x', lpad(lower(hex(cast({} as bigint))), 40, '0'))"
    return item.selectExpr(
        "chain_id", "block_number", "cast(pos as int) as pos",
        f"""named_struct(
          'type', case when l_partkey % 23 = 0 then 'reward' when l_returnflag = 'A' then 'create' when l_returnflag = 'N' then 'call' else 'suicide' end,
          'action', named_struct(
            'from', if(l_returnflag = 'R' or l_partkey % 23 = 0, null, {hexed.format("l_suppkey")}),
            'author', if(l_partkey % 23 = 0, {hexed.format("l_suppkey + 1")}, null),
            'refundAddress', if(l_returnflag = 'R', {hexed.format("l_suppkey + 2")}, null),
            'rewardType', if(l_partkey % 23 = 0, 'block', null),
            'init', if(l_returnflag = 'A', concat('0x60', lower(hex(cast(l_partkey as string)))), null)),
          'result', if(l_returnflag = 'A' and l_quantity <= 45 and l_partkey % 23 <> 0,
             named_struct('address', {hexed.format("l_partkey")}, 'code', if(l_quantity <= 5, '0x', concat('0x', lower(hex(cast(l_partkey as string)))))), null),
          'traceAddress', if(l_linenumber % 3 = 1, cast(array() as array<int>), array(l_linenumber)),
          'blockHash', concat('0x', lpad(lower(hex(block_number)), 64, '0')),
          'transactionHash', if(l_partkey % 29 = 0, null, concat('0x', lpad(lower(hex(l_partkey)), 64, '0')))) as trace""",
    )


_ITEM = """SELECT CASE WHEN l_orderkey % 5 = 0 THEN 100 ELSE 1 END::BIGINT AS chain_id, l_orderkey AS block_number,
  l_linenumber::BIGINT AS create_index, l_suppkey AS contract_address, l_orderkey % 97 AS deployer, l_partkey AS code_hash,
  (CASE WHEN l_partkey % 7 = 0 THEN 45 WHEN l_partkey % 11 = 0 THEN 0 ELSE (l_partkey * 37) % 26000 END)::BIGINT AS n_code_bytes"""

RAW = f"""raw AS ({_ITEM}, 'a' AS source_path FROM lineitem WHERE l_linenumber <= 4
  UNION ALL {_ITEM}, 'b' AS source_path FROM lineitem WHERE l_linenumber >= 3)"""

DEP = RAW + """, dep AS (SELECT chain_id, block_number, create_index, contract_address, min(deployer) AS deployer, min(code_hash) AS code_hash,
  min(n_code_bytes) AS n_code_bytes, min(source_path) AS source_path FROM raw GROUP BY chain_id, block_number, create_index, contract_address)"""

META = """meta AS (SELECT p_partkey AS code_hash,
  CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'solidity' WHEN p_type = 'PROMO' THEN 'vyper' END AS language,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_brand END AS compiler_version, p_size % 2 = 0 AS has_source_hash,
  p_partkey % 3 = 0 AS is_erc20, p_partkey % 5 = 0 AS is_erc721, p_partkey % 15 = 1 AS is_erc1155, p_partkey % 13 = 0 AS is_proxy_eip1967,
  p_partkey % 14 = 0 AS is_proxy_minimal, p_size > 25 AS uses_push0, p_size::BIGINT AS decoded_at FROM part WHERE p_partkey % 10 < 8)"""

GENERATIONS = META + """, gens AS (SELECT * FROM meta UNION ALL
  SELECT * REPLACE ('old' AS compiler_version, CASE WHEN code_hash % 8 = 0 THEN NULL ELSE decoded_at - 1 END AS decoded_at) FROM meta WHERE code_hash % 4 = 0)"""

LABELS = """one_label AS (SELECT c.chain_id::BIGINT AS chain_id, s_suppkey AS contract_address, s_acctbal > 5000 AS is_verified, s_name AS contract_name,
  CASE WHEN s_nationkey % 2 = 0 THEN 'runtime' ELSE 'metadata' END AS match_type,
  CASE WHEN s_suppkey % 10 = 3 THEN NULL ELSE s_suppkey * 37 + 900 END AS block_number FROM supplier, (VALUES (1), (100)) c(chain_id)),
  labels_ AS (SELECT * FROM one_label UNION ALL SELECT * FROM one_label WHERE contract_address % 3 = 0)"""

REGISTRY = """reg AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 100 ELSE 1 END::BIGINT AS chain_id,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_custkey END AS address,
  CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE o_orderkey * 2 END AS block_number,
  CASE WHEN o_orderkey % 13 = 0 THEN -1 ELSE o_custkey % 7 END AS transaction_index,
  'contract_deployments_' || (o_orderkey % 3) AS file FROM orders),
  ver AS (SELECT l_orderkey AS deployment_id, epoch_us(l_shipdate) // 1000000 AS created_at, l_returnflag = 'A' AS runtime_match,
  l_linestatus = 'F' AND l_linenumber > 2 AS creation_match, CASE WHEN l_quantity > 40 THEN NULL ELSE l_returnflag = 'N' END AS runtime_metadata_match,
  l_linestatus = 'O' AND l_quantity > 25 AS creation_metadata_match, 'verified_contracts_' || l_linenumber AS file FROM lineitem)"""

CHECKPOINTS = "cp AS (SELECT 1::BIGINT AS chain_id, event_id AS block_number, epoch_us(ts) // 1000000 AS block_timestamp FROM events WHERE event_id % 500 = 0)"

TRACES = """tr AS (SELECT l_orderkey AS block_number, CASE WHEN l_orderkey % 5 = 0 THEN 100 ELSE 1 END::BIGINT AS chain_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS pos,
  l_partkey, l_suppkey, l_returnflag, l_quantity, l_linenumber,
  CASE WHEN l_partkey % 23 = 0 THEN 'reward' WHEN l_returnflag = 'A' THEN 'create' WHEN l_returnflag = 'N' THEN 'call' ELSE 'suicide' END AS kind,
  l_returnflag = 'A' AND l_quantity <= 45 AND l_partkey % 23 <> 0 AS made FROM lineitem)"""

"""The wide table of deployments with metadata and labels, views over it, and bounded ad-hoc queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import schemas
from ..tables import checksum, empty
from . import decode, rollups, verification

# Spans and bounds have one row a chain, of which there are hundreds at most: these alone are broadcast.

#: Columns of a label in the wide table, and what they are there.
LABEL_COLUMNS = {"contract_name": "contract_name", "verification_source": "verification_source", "match_type": "match_type", "checked_at": "verification_checked_at"}
#: Columns of the served table that stored deployments don't have.
RAW_COLUMNS = {"transaction_hash": "binary", "tx_hash": "string", "block_hash": "binary", "block_hash_hex": "string", "factory": "binary", "factory_address": "string"}
SERVED = [
    *rollups.KEY, "address", "transaction_hash", "tx_hash", "block_hash", "block_hash_hex", "deployer", "deployer_address", "factory", "factory_address", "code_hash", "code_hash_hex", "n_code_bytes",
    "language", "compiler_version", *decode.FLAGS, "decoded_at", "is_verified", *LABEL_COLUMNS.values(),
]


def verified_default(loaded: bool):
    """is_verified of a joined label: false without one once a registry is loaded, else null."""
    return F.coalesce("is_verified", F.lit(False)) if loaded else F.col("is_verified")


def _with_metadata(rows: DataFrame, meta: DataFrame) -> DataFrame:
    found = decode.current_by_hash(meta).select("code_hash", *decode.FOUND, "decoded_at", F.lit(True).alias("is_decoded"))
    return rows.join(found, "code_hash", "left").fillna(False, [*decode.FLAGS, "is_decoded"])


def _labels(labels: DataFrame, *more: str) -> DataFrame:
    """Labels with all columns of the wide table, missing ones null."""
    if "checked_at" not in labels.columns:
        labels = labels.withColumn("checked_at", F.lit(None).cast("timestamp"))
    rows = verification.current_labels(labels)
    return rows.select("chain_id", "contract_address", "is_verified", *(F.col(c).alias(name) for c, name in LABEL_COLUMNS.items()), *more)


def wide_table(deployments: DataFrame, meta: DataFrame, labels: DataFrame, loaded: bool = True, spans: DataFrame | None = None) -> DataFrame:
    """Deployments with current metadata, and labels that carry a block within the chain's span (chain_id, first_block, last_block), by default that of these deployments."""
    spans = rollups.indexed_range(deployments) if spans is None else spans
    placed = _labels(labels, "block_number").withColumnRenamed("block_number", "_b")
    placed = placed.join(F.broadcast(spans), "chain_id").filter("_b between first_block and last_block").drop("_b", "first_block", "last_block")
    rows = _with_metadata(deployments, meta).join(placed, ["chain_id", "contract_address"], "left")
    return rows.withColumn("is_verified", verified_default(loaded))


def sorted_for_scans(wide: DataFrame, width: int = rollups.BUCKET_BLOCKS) -> DataFrame:
    """By chain and bucket and, within, newest first, so that row groups can be skipped; a large bucket is several tasks' work."""
    rows = wide.withColumn("block_bucket", rollups.bucket(width))
    order = ["chain_id", "block_bucket", F.desc("block_number")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order, F.desc("create_index"))


def fallback_view(deployments: DataFrame, meta: DataFrame, labels: DataFrame, loaded: bool = True) -> DataFrame:
    """The wide table without materializing: labels without a block count too, repeated ones repeat rows."""
    found = _labels(labels)
    rows = _with_metadata(deployments, meta).join(found, ["chain_id", "contract_address"], "left")
    return rows.withColumn("is_verified", verified_default(loaded))


def bounds(wide: DataFrame) -> DataFrame:
    return wide.groupBy("chain_id").agg(F.max("block_number").alias("bound"))


def served_view(materialized: DataFrame, bound: DataFrame, deployments: DataFrame, meta: DataFrame, loaded: bool = True) -> DataFrame:
    """The materialized rows, and deployments above the chain's bound; those have no look at labels."""
    live = deployments.join(F.broadcast(bound), "chain_id", "left").filter("bound is null or block_number > bound").drop("bound")
    live = _with_metadata(live, meta).withColumn("is_verified", F.lit(False if loaded else None).cast("boolean"))
    return materialized.unionByName(live, allowMissingColumns=True)


def all_deployments(parquet: DataFrame, contracts: DataFrame, codes: DataFrame) -> DataFrame:
    """Rows of contract files, and those of a snapshot with code by hash; what one side lacks is null."""
    from_snapshot = contracts.withColumnRenamed("bytecode_hash", "code_hash").join(codes, "code_hash", "left")
    return parquet.unionByName(from_snapshot, allowMissingColumns=True)


def _hex(column: str):
    """Bytes as 0x text; numbers, where keys are numbers, likewise."""
    return F.concat(F.lit("0x"), F.lower(F.hex(column)))


def bytecodes_view(deployments: DataFrame, counts: DataFrame | None = None, codes: DataFrame | None = None) -> DataFrame:
    """(code_hash, code_hash_hex, n_code_bytes, code, contract_count): each code hash with its code, size and use.

    Uses are counted from counts where there are any, else from deployments; code is
    that of a store (code_hash, code) with one row a hash, else that of deployments that
    bring it, else null.
    """
    if counts is not None:
        used = counts.groupBy("code_hash").agg(F.max("n_code_bytes").alias("n_code_bytes"), F.sum("contract_count").alias("contract_count"))
    else:
        used = deployments.filter("code_hash is not null").groupBy("code_hash").agg(F.max("n_code_bytes").alias("n_code_bytes"), F.count("*").alias("contract_count"))
    if codes is None and "code" in deployments.columns:
        codes = deployments.filter("code is not null").groupBy("code_hash").agg(F.min("code").alias("code"))
    used = used.join(codes.select("code_hash", "code"), "code_hash", "left") if codes is not None else used.withColumn("code", F.lit(None).cast("binary"))
    return used.select("code_hash", _hex("code_hash").alias("code_hash_hex"), "n_code_bytes", "code", "contract_count")


def presented_columns(rows: DataFrame) -> DataFrame:
    """Rows of the wide table with the columns that queries see: hex texts, and null for what only contract files have."""
    shown = {"address": _hex("contract_address"), "deployer_address": _hex("deployer"), "code_hash_hex": _hex("code_hash")}
    shown |= {c: F.lit(None).cast(kind) for c, kind in RAW_COLUMNS.items()}
    return rows.select(*(shown[c].alias(c) if c in shown else F.col(c) for c in SERVED))


def metadata_view(kind: str, deployments: DataFrame | None, meta: DataFrame | None, labels: DataFrame | None, wide: DataFrame | None = None, bound: DataFrame | None = None, loaded: bool = False) -> DataFrame:
    """What ``contract_metadata`` shows, with equal columns in three states.

    With a wide table and its bounds those rows and the live ones above; else, with
    deployments, the join without materializing; else no rows. kind is the type of keys.
    Missing metadata or labels count as empty ones.
    """
    spark = SparkSession.active()
    meta = empty(spark, schemas.metadata(kind)) if meta is None else meta
    deployments_schema = schemas.stored(kind)
    if wide is not None and bound is not None:
        return presented_columns(served_view(wide, bound, empty(spark, deployments_schema) if deployments is None else deployments, meta, loaded))
    labels = empty(spark, schemas.labels(kind)) if labels is None else labels
    return presented_columns(fallback_view(empty(spark, deployments_schema) if deployments is None else deployments, meta, labels, loaded))


def register_views(spark: SparkSession, kind: str = "binary", deployments: DataFrame | None = None, meta: DataFrame | None = None, labels: DataFrame | None = None, counts: DataFrame | None = None, codes: DataFrame | None = None,
                   wide: DataFrame | None = None, bound: DataFrame | None = None, loaded: bool = False) -> list[str]:
    """Bind the names that queries use in a session to what is loaded; returns the names.

    Called again after a refresh, they follow the tables' new versions; queries that run
    keep theirs. Names, columns and types are the same whatever is loaded.
    """
    rows = empty(spark, schemas.stored(kind)) if deployments is None else deployments
    every = metadata_view(kind, deployments, meta, labels, wide, bound, loaded)
    views = {
        "contract_metadata_all": every,
        "contract_metadata": every,
        "bytecodes": bytecodes_view(rows, counts, codes),
        "decoded_bytecodes": decoded_view(empty(spark, schemas.metadata(kind)) if meta is None else meta),
        "contract_deployments": rows,
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return [*views]


def decoded_view(meta: DataFrame) -> DataFrame:
    """Current metadata with the hash as text."""
    return decode.current_by_hash(meta).withColumn("code_hash_hex", F.concat(F.lit("0x"), F.lower(F.hex("code_hash"))))


def _texts(*rows: tuple[DataFrame, str]) -> DataFrame:
    """One row of aggregates for each table, joined as texts in order: (text)."""
    parts = [df.select(F.lit(i).alias("i"), F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns)).alias("t")) for i, (df, columns) in enumerate(rows)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]), "|").alias("text"))


def fingerprint(deployments: DataFrame, meta: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, one string: counts and latest times of the inputs. An equal one means that a rebuild can be skipped."""
    one = deployments.agg(F.count("*").alias("d"), F.max("block_number").alias("b"))
    two = meta.agg(F.count("*").alias("m"), F.max("decoded_at").alias("t"))
    three = labels.agg(F.count("*").alias("l"), F.count_if("is_verified").alias("v"))
    return _texts((one, "db"), (two, "mt"), (three, "lv")).withColumnRenamed("text", "fingerprint")


def input_mark(meta: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, one string: what the wide table's content depends on besides deployments. Equal rows in any order give an equal one."""
    one, two = (df.agg(*checksum(*sorted(df.columns))) for df in (meta, labels))
    return _texts((one, ("n", "sum_of_hashes")), (two, ("n", "sum_of_hashes"))).withColumnRenamed("text", "mark")


def stale_chains(deployments: DataFrame, wide: DataFrame, bound: DataFrame) -> DataFrame:
    """(chain_id, deployed, materialized) of chains that need a rebuild: without a bound, or with other counts up to it."""
    joined = deployments.join(F.broadcast(bound), "chain_id", "left")
    deployed = joined.filter("bound is null or block_number <= bound").groupBy("chain_id").agg(F.count("*").alias("deployed"), F.bool_or(F.col("bound").isNull()).alias("unbound"))
    keys = wide.select(*rollups.KEY).distinct().groupBy("chain_id").agg(F.count("*").alias("materialized"))
    rows = deployed.join(keys, "chain_id", "left").withColumn("materialized", F.coalesce("materialized", F.lit(0).cast("long")))
    return rows.filter("unbound or deployed <> materialized").select("chain_id", "deployed", "materialized")


def density_slices(counts: DataFrame, target: int, width: int = rollups.BUCKET_BLOCKS) -> DataFrame:
    """(chain_id, start_block, end_block, contracts): block spans of about target contracts, newest first.

    A running sum of a chain is a running sum in each coarse bucket on top of the
    sums of the buckets above; only the bucket totals meet in one place.
    """
    rows = counts.withColumn("_bucket", rollups.bucket(width))
    totals = rows.groupBy("chain_id", "_bucket").agg(F.sum("contract_count").alias("_t"))
    above = F.sum("_t").over(Window.partitionBy("chain_id").orderBy(F.desc("_bucket"))) - F.col("_t")
    totals = totals.withColumn("_above", above).drop("_t")
    inner = Window.partitionBy("chain_id", "_bucket").orderBy(F.desc("block_number")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_in", F.sum("contract_count").over(inner)).join(totals, ["chain_id", "_bucket"])
    rows = rows.withColumn("_slice", F.expr(f"(_above + _in - 1) div {max(1, target)}"))
    out = rows.groupBy("chain_id", "_slice").agg(F.min("block_number").alias("start_block"), F.max("block_number").alias("end_block"), F.sum("contract_count").alias("contracts"))
    return out.drop("_slice")


def ad_hoc(spark: SparkSession, text: str, views: dict[str, DataFrame], chain: int = 1, limit: int = 100) -> DataFrame:
    """Rows of one SELECT over some views, at most limit (1 to 1000); contract_metadata shows one chain only.

    The text stands inside a subquery, where only a query parses; files can't be named.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    for name, df in views.items():
        shared = f"adhoc_{uuid.uuid4().hex}"
        (df.filter(F.col("chain_id") == chain) if name == "contract_metadata" else df).createOrReplaceGlobalTempView(shared)
        session.table(f"global_temp.{shared}").createOrReplaceTempView(name)
        spark.catalog.dropGlobalTempView(shared)  # the session's own view has its plan
    return session.sql(f"SELECT * FROM (\n{text}\n) AS q LIMIT {min(max(limit, 1), 1000)}")


def presented(df: DataFrame, places: dict[str, int] | None = None) -> DataFrame:
    """(row): each row as JSON, bytes as 0x hex, decimals as text.

    Floating numbers with so many places as given are texts too. What rounds to zero keeps its sign there, which a decimal doesn't have.
    """
    shown = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            c = F.concat(F.lit("0x"), F.lower(F.hex(c)))
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("string")
        elif f.name in (places or {}):
            c = F.when(c.isNotNull(), F.format_string(f"%.{places[f.name]}f", c))
        shown.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("row"))

"""Verification labels from exports of a registry, full and incremental."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLAGS = ["runtime_match", "creation_match", "runtime_metadata_match", "creation_metadata_match"]
SOURCE = "registry"


def derive(deployments: DataFrame, verifications: DataFrame, chain: int) -> DataFrame:
    """Per address of a chain: highest block, least transaction index (negative ones count as unknown), last time, flags united."""
    of = deployments.filter((F.col("chain_id") == chain) & F.col("address").isNotNull())
    joined = verifications.join(of.withColumnRenamed("id", "deployment_id").drop("file"), "deployment_id")
    return joined.groupBy("address").agg(
        F.max(F.when(F.col("block_number") >= 0, F.col("block_number"))).alias("block_number"),
        F.min(F.when(F.col("transaction_index") >= 0, F.col("transaction_index"))).alias("create_index"),
        F.max("created_at").alias("checked_at"),
        *(F.bool_or(F.coalesce(f, F.lit(False))).alias(f) for f in FLAGS),
    )


def match_type():
    return F.expr("""case when runtime_match and creation_match then 'runtime+creation' when runtime_match then 'runtime'
        when creation_match then 'creation' when runtime_metadata_match or creation_metadata_match then 'metadata' else 'verified' end""")


def label_rows(derived: DataFrame, chain: int, as_of: int) -> DataFrame:
    """Labels: verified, no name, the registry as source; a missing time is as_of."""
    return derived.select(
        F.lit(chain).cast("long").alias("chain_id"), F.col("address").alias("contract_address"), F.lit(True).alias("is_verified"), F.lit(None).cast("string").alias("contract_name"),
        F.lit(SOURCE).alias("verification_source"), match_type().alias("match_type"), F.coalesce("checked_at", F.lit(as_of).cast("long")).alias("checked_at"), "block_number", "create_index",
    )


def lineage(deployments: DataFrame, verifications: DataFrame, chain: int) -> DataFrame:
    """(file, address): which verification file names which address."""
    of = deployments.filter((F.col("chain_id") == chain) & F.col("address").isNotNull()).select(F.col("id").alias("deployment_id"), "address")
    return verifications.select("deployment_id", "file").join(of, "deployment_id").select("file", "address").distinct()


def changed_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Listed verification files to read again: those not in the manifest with the same size and time.

    All of them are, if a deployment file changed, or went, or nothing was imported before.
    """
    fresh = listing.join(manifest, ["path", "length", "modified"], "left_anti")
    gone = manifest.join(listing.select("path"), "path", "left_anti").filter("is_deployment")
    every = fresh.filter("is_deployment").isEmpty() is False or not gone.isEmpty() or manifest.isEmpty()
    return (listing if every else fresh).filter("not is_deployment").select("path")


def affected(old_lineage: DataFrame, new_lineage: DataFrame, changed: DataFrame) -> DataFrame:
    """Addresses that changed files named before or name now."""
    files = changed.select(F.col("path").alias("file"))
    was, now = (x.join(files, "file", "left_semi").select("address") for x in (old_lineage, new_lineage))
    return was.union(now).distinct()


def recompute(deployments: DataFrame, verifications: DataFrame, chain: int, addresses: DataFrame) -> DataFrame:
    """derive() for some addresses only, from all verification files."""
    return derive(deployments.join(addresses, "address", "left_semi"), verifications, chain)


def replaced(labels: DataFrame, addresses: DataFrame, fresh: DataFrame, chain: int) -> DataFrame:
    """labels with those of some addresses of a chain replaced; addresses without a fresh label lose theirs."""
    gone = addresses.select(F.lit(chain).cast("long").alias("chain_id"), F.col("address").alias("contract_address"))
    return labels.join(gone, ["chain_id", "contract_address"], "left_anti").unionByName(fresh)


def consistent(labels: DataFrame, imports: DataFrame) -> DataFrame:
    """(chain_id, recorded, labelled, unplaced, consistent): recorded counts against labels, and labels without position."""
    have = labels.filter(F.col("verification_source") == SOURCE).groupBy("chain_id").agg(F.count("*").alias("labelled"), F.count_if(F.col("block_number").isNull()).alias("unplaced"))
    rows = imports.join(have, "chain_id", "left").fillna(0, ["labelled", "unplaced"])
    return rows.withColumn("consistent", F.expr("recorded = labelled and unplaced = 0"))


def pruned_manifest(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """The manifest after an import: the listing, so that vanished paths are gone."""
    return listing.select(*manifest.columns)


def current_labels(labels: DataFrame) -> DataFrame:
    """Labels with all columns, missing ones null; a missing chain is 1."""
    columns = {"contract_name": "string", "verification_source": "string", "match_type": "string", "block_number": "long", "create_index": "long"}
    out = labels.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in labels.columns})
    chain = F.coalesce("chain_id", F.lit(1)) if "chain_id" in labels.columns else F.lit(1)
    return out.withColumn("chain_id", chain.cast("long"))


def verified_count(labels: DataFrame) -> DataFrame:
    return labels.filter("is_verified").groupBy("chain_id").agg(F.count("*").alias("verified"))

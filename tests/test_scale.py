"""What a task reads, and how many files are written, on tables in several files."""

import glob
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from deploy_analytics import jobs
from deploy_analytics.operators import extract
from deploy_analytics.plans import bindings as b
from deploy_analytics.plans import queries as q
from deploy_analytics.streaming.follow import Follower

FILES = 6


@pytest.fixture(scope="module")
def many(spark, sf, tmp_path_factory):
    """The smallest tables, lineitem and documents in as many files as there are tasks to read them."""
    root = tmp_path_factory.mktemp("many")
    for path in glob.glob(f"{sf}/*.parquet"):
        os.symlink(path, f"{root}/{os.path.basename(path)}")
    for name in ("lineitem", "documents"):
        os.unlink(f"{root}/{name}.parquet")
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(FILES).write.parquet(f"{root}/{name}.parquet")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 27))  # a file is a split
    yield str(root)
    for k, v in before.items():
        spark.conf.set(k, v)


def parts(folder):
    return len(glob.glob(f"{folder.removeprefix('file://')}/**/*.parquet", recursive=True))


def test_sources_land_from_all_splits(spark, many):
    root = q.landed_sources(spark, many)
    assert parts(f"{root}/a") > 2 and parts(f"{root}/b") > 2


def test_followed_files_land_from_all_splits(spark, many, monkeypatch):
    seen = []
    run = lambda folder: seen.append(parts(folder)) or SimpleNamespace(awaitTermination=lambda: None)
    monkeypatch.setattr(q, "_follower", lambda *_: SimpleNamespace(run=run))
    q._follow(spark, many, "landing")
    assert seen[-1] > 6


def test_landed_files_have_a_bounded_size(spark, many, tmp_path, monkeypatch):
    monkeypatch.setattr(q, "FILE_ROWS", 500)
    rows = b.raw_deployments(spark, many)
    third = q._land_in_thirds(rows, f"{tmp_path}/in")
    assert third > 1 and parts(str(tmp_path)) == 3 * third and spark.read.parquet(f"{tmp_path}/in").count() == rows.count()


def test_traces_land_compressed_and_little_of_them_is_shuffled(spark, many, monkeypatch):
    paths = []
    monkeypatch.setattr(q, "scratch", lambda spark, name: paths.append(scratch(spark, name)) or paths[-1])
    rows = q.landed_traces(spark, many)
    assert all(f.endswith(".json.gz") for f in glob.glob(f"{paths[-1].removeprefix('file://')}/part-*"))
    node, dealt = extract.deployments(rows, hashes=False)._jdf.queryExecution().optimizedPlan(), None
    while node.children().nonEmpty():
        node = node.children().head()
        if node.nodeName() == "Window":
            dealt = [node.children().head().output().apply(i).name() for i in range(node.children().head().output().size())]
    assert "sender" in dealt and "trace" not in dealt


scratch = q.scratch


def test_a_batch_writes_few_files_to_partitions_of_blocks(spark, tmp_path):
    own = Follower(spark, f"file://{tmp_path}/out", 0, 1, "bigint", with_code=False)
    rows = spark.range(4000).select(
        F.lit(1).cast("long").alias("chain_id"), F.col("id").alias("block_number"), F.lit(0).cast("long").alias("create_index"), F.col("id").alias("contract_address"),
        F.lit(1).cast("long").alias("deployer"), F.lit(2).cast("long").alias("code_hash"), F.lit(3).cast("long").alias("n_code_bytes"), F.lit("a").alias("source_path"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        own.take(rows.filter("block_number % 2 = 0"), 1)
        own.take(rows, 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts(f"{tmp_path}/out/generation=0/deployments/segment=2-2.0") <= 40 + 4  # partitions and tasks, not their product
    assert own.deployments().count() == 4000


def test_buckets_of_the_wide_table_share_files(spark, sf):
    wide = jobs.WideTable(spark, q.scratch(spark, "wide"), 10)
    wide.refresh(q.dep(spark, sf), b.metadata(spark, sf), b.labels(spark, sf).dropDuplicates(["chain_id", "contract_address"]))
    assert wide.parts.manifest(1).count() > 100 and parts(f"{wide.root}/wide/rows") < 20
    assert wide.table("wide").count() == q.dep(spark, sf).count()

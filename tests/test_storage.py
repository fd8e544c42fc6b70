"""Stored state: segments and their levels, held rows, the code store, tables in parts and the jobs over them."""

import glob
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from deploy_analytics import jobs, schemas
from deploy_analytics.operators import blocktime, decode, explorer
from deploy_analytics.sources import contracts, sinks
from deploy_analytics.streaming.follow import Follower, LiveCounts
from deploy_analytics.tables import Parts, Segment, Segments

STORED = schemas.stored("bigint")


def follower(spark, path, **more):
    return Follower(spark, f"file://{path}/out", kind="bigint", **({"with_code": False, "confirmations": 0} | more))


class Plain:
    """What a follower that is never interrupted has."""

    def __init__(self, confirmations):
        self.confirmations, self.stored, self.held, self.head = confirmations, {}, [], {}

    def tick(self, rows):
        rows = rows + self.held
        for chain, block, *_ in rows:
            self.head[chain] = max(block, self.head.get(chain, 0))
        safe = lambda r: r[1] <= self.head[r[0]] - self.confirmations
        self.held, new = [r for r in rows if not safe(r)], {}
        for r in filter(safe, rows):
            new.setdefault(r[:4], []).append(r[7])
        for key, sources in new.items():
            self.stored.setdefault(key, min(sources))

    def remove(self, source):
        self.stored = {k: s for k, s in self.stored.items() if s != source}
        self.held = [r for r in self.held if r[7] != source]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_order_of_steps_ends_like_an_uninterrupted_run(spark, tmp_path, seed):
    draw = random.Random(seed)
    plain, own = Plain(3), follower(spark, tmp_path, confirmations=3, fanout=2, grace=0)
    at, batch = 100, 0
    for step in [draw.choice(["tick", "tick", "compact", "remove", "backfill", "again"]) for _ in range(9)] + ["tick", "compact"]:
        if step == "tick":
            rows = [(draw.choice([1, 7]), at + draw.randrange(-4, 8), 0, draw.randrange(5), 1, draw.randrange(3), 2, draw.choice("abc")) for _ in range(12)]
            at += 5
            plain.tick(rows)
            own.ingest(spark.createDataFrame(rows, STORED), batch)
            batch += 1
        elif step == "remove":
            source = draw.choice("abcd")
            plain.remove(source)
            own.remove_source(source)
        elif step == "again" and batch:  # a tick that counts already, as after a crash of the stream
            own.ingest(spark.createDataFrame([], STORED), batch - 1)
        else:
            {"compact": own.compact}.get(step, own.backfill)()
    found = own.deployments().collect()
    assert {(r.chain_id, r.block_number, r.create_index, r.contract_address): r.source_path for r in found} == plain.stored and len(found) == len(plain.stored)
    assert sum(r.contract_count for r in own.block_counts().collect()) == len(plain.stored)
    for counts in (own.code_counts(), own.bucket_code_counts()):
        assert sum(r.contract_count for r in counts.collect()) == len(plain.stored)
    assert {(r.block_number, r.source_path) for r in own.held().collect()} == {(r[1], r[7]) for r in plain.held}


def test_held_rows_survive_what_comes_between(spark, tmp_path):
    own = follower(spark, tmp_path, confirmations=12)
    rows = lambda a, z: spark.createDataFrame([(1, x, 0, x, 1, 9, 2, "a") for x in range(a, z)], STORED)
    own.ingest(rows(1, 101), 0)
    own.compact()
    own.remove_source("zzz")
    own.backfill()
    own.ingest(rows(101, 201), 1)
    assert own.deployments().count() == 188 and own.held().count() == 12
    own.compact()
    own.ingest(rows(201, 213), 2)
    assert own.deployments().count() == 200


def test_many_ticks_keep_few_folders(spark, tmp_path):
    own = follower(spark, tmp_path, fanout=3, grace=0)
    for i in range(14):
        own.ingest(spark.createDataFrame([(1, 10 * i + k, 0, k, 1, 9, 2, f"f{i}") for k in range(3)], STORED), i)
        assert len(own.tables.all()) <= 6
    assert [s.level for s in own.tables.cover()] == [2, 1, 0, 0]
    assert own.deployments().count() == 42 and own.code_counts().first().contract_count == 42
    assert len(glob.glob(f"{tmp_path}/out/generation=0/deployments/segment=*")) == 4
    assert not glob.glob(f"{tmp_path}/out/generation=0/work_*/segment=*")


def test_readers_of_merged_segments_finish(spark, tmp_path):
    own = follower(spark, tmp_path, fanout=2)
    for i in range(2):
        own.ingest(spark.createDataFrame([(1, i, 0, i, 1, 9, 2, "a")], STORED), i)
        if i == 0:
            old = own.deployments()
    own.remove_source("a")
    assert old.count() == 1 and own.deployments().count() == 0
    own.compact()
    assert old.count() == 1 and own.tables.clean(3600) == 0
    assert own.tables.clean(0) > 0 and own.deployments().count() == 0 and own.block_counts().count() == 0


def test_segments_cover_and_due(spark, tmp_path):
    own = Segments(spark, f"file://{tmp_path}/s", "m", fanout=2)
    one = spark.range(1)
    for n in (3, 7, 9):
        own.append("m", one, n)
    assert own.due() == [Segment(3, 3), Segment(7, 7), Segment(9, 9)]
    own.write("m", one, Segment(3, 7, 1))
    assert own.cover() == [Segment(3, 7, 1), Segment(9, 9)] and own.due() == [] and own.has(5) and not own.has(8)
    assert Segment.of(Segment(3, 7, 1).folder) == Segment(3, 7, 1)


def test_code_is_stored_once_and_found_by_parts(spark, tmp_path):
    own = follower(spark, tmp_path, with_code=True, fanout=2)
    rows = lambda *hashes: spark.createDataFrame([(1, i, 0, i, 1, h, 2, "a", bytearray(b"\x5f" + bytes([h]))) for i, h in enumerate(hashes)], STORED + ", code binary")
    own.ingest(rows(1, 2, 2, 3), 0)
    own.ingest(rows(9, 8, 7, 3, 4, 1), 1)
    own.ingest(rows(4, 5), 2)
    assert sorted((r.code_hash, bytes(r.code)) for r in own.codes().collect()) == [(h, b"\x5f" + bytes([h])) for h in (1, 2, 3, 4, 5, 7, 8, 9)]
    assert {r.code_hash: r.uses_push0 for r in own.metadata().collect()} == dict.fromkeys((1, 2, 3, 4, 5, 7, 8, 9), True)
    plan = own.unknown_hashes(rows(3), own.tables.cover())._jdf.queryExecution().executedPlan().toString()
    assert "hash_part" in plan.split("PartitionFilters: [")[1].split("]")[0]
    view = explorer.bytecodes_view(own.deployments(), own.code_counts(), own.codes()).collect()
    assert {r.code_hash: (bytes(r.code), r.code_hash_hex) for r in view}[3] == (b"\x5f\x03", "0x3")


def test_snapshot_is_loaded_once_and_replaced(spark, tmp_path):
    own = follower(spark, tmp_path, confirmations=12)
    codes = spark.createDataFrame([(h, h) for h in range(5)], "code_hash long, n_code_bytes long")
    snapshot = lambda n: spark.range(n).selectExpr("cast(null as bigint) chain_id", "id div 5 block_number", "id % 5 create_index", "id contract_address", "id % 5 bytecode_hash")
    assert own.load("snapshot", snapshot(10_000), codes) and not own.load("snapshot", snapshot(20), codes)
    assert own.block_counts().agg(F.sum("contract_count")).first()[0] == 10_000
    assert {r.code_hash: (r.contract_count, r.n_code_bytes) for r in own.code_counts().collect()} == {h: (2000, h) for h in range(5)}
    assert [tuple(r)[1:] for r in own.sources().collect()] == [(0, 1999, 10_000)] and own.source_slices().count() == 1
    assert own.load("snapshot", snapshot(7_000), codes, again=True)
    own.compact()
    assert own.block_counts().agg(F.sum("contract_count")).first()[0] == 7_000 == own.deployments().count()


def test_ticks_store_the_time_of_heads_that_are_due(spark, tmp_path):
    headers = spark.createDataFrame([(1, b, 1_000_000 + 14 * b) for b in (10, 5_000, 7_000)], "chain_id long, block_number long, block_timestamp long")
    own = follower(spark, tmp_path, headers=lambda: headers, fanout=2)
    for i, head in enumerate((10, 5_000, 7_000, 14_000, 14_001)):
        own.ingest(spark.createDataFrame([(1, head, 0, 1, 1, 9, 2, "a")], STORED), i)
    own.ingest(spark.createDataFrame([(1, 7_000, 0, 1, 1, 9, 2, "a")], STORED), 2)
    assert {r.block_number for r in own.checkpoints().collect()} == {10, 7_000}  # 5,000 isn't due, and 14,000 has no header
    asked = spark.createDataFrame([(1, 3_505)], "chain_id long, block_number long")
    assert blocktime.block_times(asked, own.checkpoints()).first().block_time == 1_000_000 + 14 * 3_505


def test_parts_are_replaced_and_consolidated(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Parts, "MOST", 3)
    parts = Parts(spark, f"file://{tmp_path}/p", "k")
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "k int, v long")
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k int")
    seen = lambda version: sorted(map(tuple, parts.rows(version).collect()))
    now = parts.replace(None, rows((1, 1), (1, 2), (2, 3)), keys(1, 2, 3))
    first = parts.rows(now)
    for i in range(4, 9):
        now = parts.replace(now, rows((i, i)), keys(i))
    assert seen(now) == [(1, 1), (1, 2), (2, 3), *((i, i) for i in range(4, 9))]
    assert parts.manifest(now).select("in_version").distinct().count() <= 4
    now = parts.replace(now, rows((2, 9)), keys(2), keys(4, 5))
    assert seen(now) == [(1, 1), (1, 2), (2, 9), (6, 6), (7, 7), (8, 8)]
    parts._write(rows((1, 77)), f"rows/in_version={now + 1}", ["k"])  # died before its manifest
    assert seen(now) == [(1, 1), (1, 2), (2, 9), (6, 6), (7, 7), (8, 8)] and first.count() == 3
    now = parts.replace(now, rows(), keys(1))
    parts.clean(now, 0)
    assert seen(now) == [(2, 9), (6, 6), (7, 7), (8, 8)] and parts.manifest(now).filter("k = 1").count() == 1


def contract_rows(spark, *hashes):
    rows = [(1, h, 0, bytearray(bytes([h]) * 20), bytearray(bytes([h]) * 32), 2, bytearray(b"\x5f" + bytes([h]))) for h in hashes]
    df = spark.createDataFrame(rows, "chain_id long, block_number long, create_index long, contract_address binary, code_hash binary, n_code_bytes long, code binary")
    return df.withColumn("chain_id", F.col("chain_id").cast("decimal(20,0)"))


def test_files_are_decoded_once_for_their_size_and_time(spark, tmp_path):
    land = lambda name, *hashes: contract_rows(spark, *hashes).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/in/{name}")
    listing = lambda: contracts.list_files(spark, f"{tmp_path}/in")
    job, read = jobs.DecodedFiles(spark, f"file://{tmp_path}/out"), []

    def reading(paths):
        read.append(len(paths))
        return job.read_files(paths)

    found = lambda: sorted(bytes(r.contract_address)[0] for r in job.addresses().collect())
    land("a", 1, 2)
    land("b", 2, 3)
    assert job.run(listing(), "2024-01-01", 1, reading) == 2 and read == [1, 1] and found() == [1, 2, 2, 3]
    assert job.run(listing(), "2024-01-01", 1, reading) == 0 and job.metadata().count() == 3
    land("c", 4)
    half = contract_rows(spark, 4).select("chain_id", F.lit("x").alias("file_id"))
    job.files._write(half, f"rows/in_version={job.files.version() + 1}", ["file_id"])  # killed before the manifest
    assert found() == [1, 2, 2, 3]

    def dies(paths):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        job.run(listing(), "2024-01-01", read=dies)
    assert job.run(listing(), "2024-01-01", read=reading) == 1 and found() == [1, 2, 2, 3, 4]
    name = next(p for p in glob.glob(f"{tmp_path}/in/c/*.parquet"))
    contract_rows(spark, 5, 6).coalesce(1).write.parquet(f"{tmp_path}/new")
    with open(next(p for p in glob.glob(f"{tmp_path}/new/*.parquet")), "rb") as new, open(name, "wb") as old:
        old.write(new.read())
    for crc in glob.glob(f"{tmp_path}/in/c/.*.crc"):
        os.unlink(crc)
    assert job.run(listing(), "2024-01-01", read=reading) == 1 and found() == [1, 2, 2, 3, 5, 6]
    clean = jobs.DecodedFiles(spark, f"file://{tmp_path}/clean")
    clean.run(listing(), "2024-01-01")
    columns = [c for c in clean.addresses().columns if c != "decoded_at"]
    assert {tuple(r) for r in job.addresses().select(columns).collect()} == {tuple(r) for r in clean.addresses().select(columns).collect()}
    assert job.run(listing(), "2024-01-02", overwrite=True, files_a_run=2) == 3 and found() == [1, 2, 2, 3, 5, 6]


FLAGS = ", ".join(f"{f} boolean" for f in decode.FLAGS)


def test_a_late_row_rewrites_one_bucket(spark, tmp_path):
    flags = dict.fromkeys(decode.FLAGS, False)
    meta = lambda *hashes: spark.createDataFrame([{"code_hash": h, "language": "solidity", "compiler_version": "0.8", "decoded_at": 1, **flags} for h in hashes], "code_hash long, language string, compiler_version string, decoded_at long, " + FLAGS)
    rows = lambda *blocks: spark.createDataFrame([(1, x, 0, x % 30, 5, x % 3, 100) for x in blocks], "chain_id long, block_number long, create_index long, contract_address long, deployer long, code_hash long, n_code_bytes long")
    labels = lambda *pairs: spark.createDataFrame([(1, a, True, "n", "runtime", b) for a, b in pairs], "chain_id long, contract_address long, is_verified boolean, contract_name string, match_type string, block_number long")
    wide = jobs.WideTable(spark, f"file://{tmp_path}/wide", 10)
    given = {"deployments": rows(*range(5, 60, 2)), "meta": meta(0, 1), "labels": labels((7, 7), (25, 25), (11, 71))}

    def refreshed(**change):
        given.update(change)
        n = wide.refresh(**given)
        whole = explorer.wide_table(**given)
        assert sorted(map(str, wide.table("wide").select(whole.columns).collect())) == sorted(map(str, whole.collect()))
        return n

    assert refreshed() == 6 and refreshed() == 0
    assert refreshed(deployments=rows(*range(5, 60, 2), 22)) == 1
    assert refreshed(deployments=rows(*[x for x in range(5, 60, 2) if x // 10 != 3], 22)) == 0  # a bucket is gone, and none is written
    assert refreshed(meta=meta(0, 1, 2)) == 5
    assert refreshed(labels=labels((7, 7), (25, 25), (11, 71), (9, 9))) == 1
    # blocks above the bounds are served live; once a late row calls for a refresh they come along, and so does a label that the longer span takes in
    given["deployments"] = rows(*[x for x in range(5, 60, 2) if x // 10 != 3], 22, 75)
    assert wide.refresh(**given) == 0
    assert wide.served(given["deployments"], given["meta"]).count() == given["deployments"].count()
    assert refreshed(deployments=rows(*[x for x in range(5, 60, 2) if x // 10 != 3], 22, 24, 75)) == 4
    wide.clean(0)
    assert wide.table("wide").count() == given["deployments"].count()


def test_an_update_reads_the_files_that_it_needs(spark, tmp_path):
    deployed = spark.createDataFrame([(i, 1, 10 + i, 5, 0, "d") for i in range(1, 7)], "id long, chain_id long, address long, block_number long, transaction_index long, file string")
    matches = ("runtime_match", "creation_match", "runtime_metadata_match", "creation_metadata_match")
    tables = {"v1": [1, 2], "v2": [2, 3], "v3": [4, 5], "v4": [6]}
    read = []

    def reading(files):
        names = sorted(tables) if files is None else sorted(r.file for r in files.collect())
        read.append(names)
        rows = spark.createDataFrame([(i, 100, n) for n in names for i in tables.get(n, [])], "deployment_id long, created_at long, file string")
        return rows.withColumns({c: F.lit(True) for c in matches})

    listing = lambda: spark.createDataFrame([(n, 1, len(t), False) for n, t in tables.items()] + [("d", 1, 1, True)], "path string, length long, modified long, is_deployment boolean")
    registry = jobs.Registry(spark, f"file://{tmp_path}/registry", 1)
    addresses = lambda: {r.contract_address for r in registry.table("labels").collect()}
    assert registry.refresh(listing(), deployed, reading, 0) == "imported" and addresses() == {11, 12, 13, 14, 15, 16}
    read.clear()
    assert registry.refresh(listing(), deployed, reading, 0) == "unchanged" and read == []
    tables["v1"] = [1, 4, 5]  # another size
    read.clear()
    assert registry.refresh(listing(), deployed, reading, 0) == "updated"
    assert read == [["v1"], ["v1", "v2", "v3"]]  # 12 is named by v2 still, 14 and 15 by v3
    assert addresses() == {11, 12, 13, 14, 15, 16}
    del tables["v4"]
    read.clear()
    assert registry.refresh(listing(), deployed, reading, 0) == "updated" and addresses() == {11, 12, 13, 14, 15}
    assert read == [["v4"], []]
    registry.clean(0)
    assert addresses() == {11, 12, 13, 14, 15} and len(glob.glob(f"{tmp_path}/registry/version=*")) == 1
    assert {(r.file, r.address) for r in registry.table("lineage").collect()} == {(n, 10 + i) for n, t in tables.items() for i in t}


def test_views_have_equal_columns_whatever_is_loaded(spark):
    rows = spark.createDataFrame([(1, 5, 0, 255, 1, 9, 2, "a"), (1, 8, 0, 256, 1, 8, 2, "a")], STORED)
    meta = spark.createDataFrame([(9, "solidity", "0.8", *[True] * 7, None)], schemas.metadata("bigint"))
    labels = spark.createDataFrame([(1, 255, True, "n", "registry", "runtime", None, 5, 0)], schemas.labels("bigint"))
    wide = explorer.wide_table(rows.filter("block_number < 8"), meta, labels)
    states = [{}, {"deployments": rows}, {"deployments": rows, "meta": meta, "labels": labels, "loaded": True}]
    states.append(states[-1] | {"wide": wide, "bound": explorer.bounds(wide)})
    seen = []
    for given in states:
        names = explorer.register_views(spark, "bigint", **given)
        seen.append({n: spark.table(n).dtypes for n in names})
        seen[-1].pop("contract_deployments")
        found = spark.sql("select address, is_erc20, is_verified, verification_source from contract_metadata order by block_number").collect()
        assert len(found) == (2 if given else 0)
    assert all(s == seen[0] for s in seen) and tuple(found[0]) == ("0xff", True, True, "registry")


def test_ad_hoc_queries_leave_no_views(spark):
    before = {t.name for t in spark.catalog.listTables("global_temp")}
    df = explorer.ad_hoc(spark, "select * from contract_metadata", {"contract_metadata": spark.createDataFrame([(1, 5)], "chain_id long, block_number long")})
    assert df.count() == 1 and {t.name for t in spark.catalog.listTables("global_temp")} == before


def test_chunks_are_written_once_and_reported(spark, tmp_path):
    rows = spark.createDataFrame([(1, b, 0) for b in (3, 12, 14, 35)], "chain_id long, block_number long, create_index long")
    sink = sinks.ChunkedSink(spark, f"file://{tmp_path}/c", 0, 10)
    status = lambda df: [(r.chunk, r.rows, r.status) for r in df.orderBy("chunk").collect()]
    assert status(sink.run(rows.filter("block_number < 20"), 19)) == [(0, 1, "written"), (1, 2, "written")]
    assert status(sink.run(rows, 35)) == [(0, 1, "skipped"), (1, 2, "skipped"), (2, 0, "empty"), (3, 1, "written")]
    files = {p: open(p, "rb").read() for p in glob.glob(f"{tmp_path}/c/chain_id=*/*/*.parquet")}
    again = sink.run(rows, 35)
    assert {r.status for r in again.collect()} == {"skipped"} and files == {p: open(p, "rb").read() for p in glob.glob(f"{tmp_path}/c/chain_id=*/*/*.parquet")}
    lines = [json.loads(x) for p in glob.glob(f"{tmp_path}/c/_reports/run=3/*.json") for x in open(p)]
    assert {(x["chunk"], x["rows"], x["bytes"]) for x in lines} == {(r.chunk, r["rows"], r.bytes) for r in again.collect()}
    assert sum(x["bytes"] for x in lines) == sum(map(len, files.values()))
    assert status(sink.run(rows, 39))[3] == (3, 1, "written")  # its last block is another one now
    assert spark.read.parquet(f"{tmp_path}/c").count() == 4


def test_small_chunks_share_folders(spark, tmp_path):
    rows = spark.range(400).selectExpr("if(id % 5 = 0, 100L, 1L) as chain_id", "id as block_number", "0L as create_index", "id * 3 as contract_address")
    sink = sinks.ChunkedSink(spark, f"file://{tmp_path}/c", 0, 10)
    files = lambda: glob.glob(f"{tmp_path}/c/chain_id=*/**/*.parquet", recursive=True)
    sink.run(rows.filter("block_number < 200"), 199)
    report = sink.run(rows.filter("block_number >= 100"), 399).collect()
    assert len(files()) <= 16  # tasks and folders, not one a chunk and chain
    assert [(r.chunk, r["rows"], r.min_block, r.max_block, r.status) for r in sorted(report)] == [(c, 10, 10 * c, 10 * c + 9, "skipped" if c < 20 else "written") for c in range(40)]
    assert all(r.bytes > 0 for r in report) and sum(r.bytes for r in report) == sum(map(os.path.getsize, files()))
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/c").select("chain_id", "block_number", "contract_address").collect())
    every = sorted(tuple(r) for r in rows.select("chain_id", "block_number", "contract_address").collect())
    assert read() == every
    sinks.write_chunks(rows.filter("block_number < 30").withColumn("contract_address", F.lit(-1).cast("long")), f"file://{tmp_path}/c", 0, spark.range(1, 2).withColumnRenamed("id", "chunk"), 10)
    assert read() == sorted((c, b, -1 if b < 30 and b // 10 != 1 else a) for c, b, a in every)
    for p in glob.glob(f"{tmp_path}/c/chain_id=1/**/*.parquet", recursive=True):
        os.unlink(p)  # a folder of one chain is lost: its chunks aren't there, whatever the other has of them
    assert {r.status for r in sink.run(rows, 399).collect()} == {"written"} and read() == every


def test_live_counts_write_what_changed(spark, tmp_path):
    live = LiveCounts(spark, f"file://{tmp_path}/live", fanout=2, grace=0)
    rows = lambda *counts: spark.createDataFrame([(1, b, n) for b, n in counts], "chain_id long, bucket_id long, count long")
    seen = lambda: {r.bucket_id: r["count"] for r in live.table().collect()}
    live.update(rows((0, 3), (1, 1)), 0)
    live.update(rows((1, 4)), 1)
    assert seen() == {0: 3, 1: 4} and [s.level for s in live.tables.all()] == [1]
    live.update(rows((2, 9)), 2)
    live.update(rows((2, 7)), 2)  # a trigger that counts already
    assert spark.read.parquet(f"{tmp_path}/live/counts/segment=2-2.0").count() == 1
    assert seen() == {0: 3, 1: 4, 2: 9}


def test_old_generations_are_deleted(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 0, 1, 1, 9, 2, "a"), (1, 2, 0, 1, 1, 9, 2, "b")], STORED)
    own, files = follower(spark, tmp_path, grace=0), lambda *x: spark.createDataFrame([(n,) for n in x], "source_path string")
    read = lambda new: rows.join(new, "source_path", "left_semi")
    own.sync(files("a", "b"), read)
    assert [r.source_path for r in own.sync(files("b"), read).collect()] == ["a"]
    own.sync(files("b"), read)
    assert [os.path.basename(p) for p in glob.glob(f"{tmp_path}/out/generation=*")] == ["generation=1"]
    assert own.deployments().count() == 1

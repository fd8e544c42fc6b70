"""Golden values and small fixtures of the operators."""

import pytest
from pyspark.sql import functions as F

from deploy_analytics import jobs, schemas
from deploy_analytics.operators import analytics, blocktime, decode, explorer, extract, rollups, verification
from deploy_analytics.sources import contracts, landed
from deploy_analytics.streaming.follow import TICK, Follower
from deploy_analytics.tables import Tables

# Published checkpoints and the windows that follow from them.
CHECKPOINTS = [
    (1, 24_000_000, 1_765_584_371), (1, 25_497_188, 1_783_626_143), (100, 46_762_380, 1_781_798_438), (100, 47_119_233, 1_783_626_150), (9999, 100, 1000), (9999, 200, 2000),
]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(CHECKPOINTS, "chain_id long, block_number long, block_timestamp long")


def test_block_times(spark, points):
    rows = spark.createDataFrame([(9999, 150), (9999, 50), (9999, 300), (1, 24_000_000), (1, 25_497_188), (7, 5), (100, 47_119_333)], "chain_id long, block_number long")
    got = {(r.chain_id, r.block_number): r.block_time for r in blocktime.block_times(rows, points).collect()}
    assert got[9999, 150] == 1500 and got[9999, 50] == 1000 and got[9999, 300] == 3000
    assert got[1, 24_000_000] == 1_765_584_371 and got[1, 25_497_188] == 1_783_626_143 and got[7, 5] == 0
    rate = (1_783_626_150 - 1_781_798_438) * 1000 // (47_119_233 - 46_762_380)
    assert got[100, 47_119_333] == 1_783_626_150 + 100 * rate // 1000


def test_time_blocks(spark, points):
    rows = spark.createDataFrame([(9999, 1750), (9999, 10), (9999, 2500), (7, 9)], "chain_id long, time long")
    got = {(r.chain_id, r.time): r.block_number for r in blocktime.time_blocks(rows, points).collect()}
    assert got == {(9999, 1750): 175, (9999, 10): 100, (9999, 2500): 250, (7, 9): 0}


def test_lone_checkpoint_uses_slot_times(spark):
    one = spark.createDataFrame([(100, 10, 500), (1, 10, 500)], "chain_id long, block_number long, block_timestamp long")
    rows = spark.createDataFrame([(100, 20), (1, 20), (1, 16_000_000)], "chain_id long, block_number long")
    got = sorted(r.block_time for r in blocktime.block_times(rows, one).collect())
    assert got == [550, 640, 500 + (16_000_000 - 10) * 12]


def test_windows(spark):
    specs = [
        (1, 20_000_000, "day", None, None, None), (1, 20_000_000, "week", None, None, None), (1, 20_000_000, "year", None, None, None), (100, 46_000_000, "hour", None, None, None),
        (1, 20_000_000, None, None, 19_900_000, 19_950_000), (1, 20_000_000, None, None, None, None), (1, 100, "week", "hour", None, 5000),
    ]
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(specs)], "i int, chain_id long, anchor_block long, range string, bucket string, start_block long, end_block long")
    got = [(r.range_start, r.range_end, r.bucket_blocks) for r in blocktime.windows(df).orderBy("i").collect()]
    assert got == [
        (19_992_801, 20_000_000, 300), (19_949_601, 20_000_000, 7200), (17_372_001, 20_000_000, 216_000), (45_999_281, 46_000_000, 60),
        (19_900_000, 19_950_000, 520), (None, None, 7200), (0, 100, 257),
    ]


def test_sampled_blocks(spark):
    ranges = spark.createDataFrame([(1, 47_205, 250_001)], "chain_id long, first_block long, last_block long")
    assert sorted(r.block_number for r in blocktime.sample_blocks(ranges).collect()) == [47_205, 100_000, 200_000, 250_001]


def test_density_slices(spark):
    rows = spark.createDataFrame([(1, 100, 1), (1, 90, 9), (1, 80, 6), (1, 70, 6), (100, 200, 3)], "chain_id long, block_number long, contract_count long")
    got = {(r.chain_id, r.start_block, r.end_block) for r in explorer.density_slices(rows, 10, 25).collect()}
    assert got == {(1, 90, 100), (1, 80, 80), (1, 70, 70), (100, 200, 200)}


def test_ranges_are_exact_at_every_alignment(spark):
    blocks = [5000, *range(10_000, 20_000, 1000), 25_000]
    rows = spark.createDataFrame([(1, x, 0, i, 7, 100) for i, x in enumerate(blocks)], "chain_id long, block_number long, create_index long, contract_address long, code_hash long, n_code_bytes long")
    codes, buckets = rollups.code_counts(rows), rollups.bucket_code_counts(rows)
    for span, total in (((5000, 25_000), 12), ((10_000, 19_999), 10), ((5000, 9999), 1), ((0, 1_000_000), 12), ((10_001, 19_998), 9), ((4999, 10_000), 2)):
        got = analytics.code_counts_in(codes, buckets, rows, 1, span).agg(F.sum("contract_count")).first()[0]
        assert got == total, span


def test_traces_of_a_block(spark):
    create = lambda frm, to, at, code="0x6001": {"type": "create", "action": {"from": frm, "init": "0x60"}, "result": {"address": to, "code": code}, "traceAddress": at, "blockHash": "0x" + "11" * 32, "transactionHash": "0x" + "22" * 32}
    a, c, d = ("0x" + x * 40 for x in "acd")
    traces = [
        {"type": "reward", "action": {"author": d, "rewardType": "block"}, "traceAddress": []},
        {"type": "call", "action": {"from": a}, "traceAddress": [], "blockHash": "0x" + "11" * 32},
        create(c, d, [0]),
        {**create(c, d, [1]), "result": None},
        create(c, a, [], "0x"),
    ]
    reward = [traces[0]]
    df = spark.createDataFrame([(1, 5, traces), (1, 6, reward)], schemas.TRACE_LINES).select("chain_id", "block_number", F.posexplode("traces").alias("pos", "trace"))
    rows = extract.deployments(df).orderBy("create_index").collect()
    assert [(r.create_index, bytes(r.deployer).hex()[0], bytes(r.factory).hex()[0], r.n_code_bytes) for r in rows] == [(0, "a", "c", 2), (1, "c", "c", 0)]
    assert bytes(rows[1].code_hash).hex().startswith("c5d24601")
    too_high = df.withColumn("block_number", F.lit(2**32))
    with pytest.raises(Exception, match="overflows"):
        extract.deployments(too_high).collect()


STORED = schemas.stored("bigint")


def follower_of_numbers(spark, path):
    return Follower(spark, f"file://{path}/out", 0, kind="bigint", with_code=False)


def test_overlapping_files_count_once(spark, tmp_path):
    rows = [(1, 300, 0, 5, 1, 9, 2, "a"), (1, 301, 0, 6, 1, 9, 2, "a")]
    follower = follower_of_numbers(spark, tmp_path)
    for i, part in enumerate((rows, rows[:1], [])):
        spark.createDataFrame(part, STORED).write.parquet(f"{tmp_path}/in/{i}")
    for i in range(3):
        follower.ingest(spark.read.parquet(f"{tmp_path}/in/{i}"), i)
    assert follower.deployments().count() == 2
    assert follower.block_counts().agg(F.sum("contract_count")).first()[0] == 2
    follower.compact()
    assert {r.block_number for r in follower.block_counts().collect()} == {300, 301}
    assert follower.deployments().count() == 2 and follower.code_counts().first().contract_count == 2


def test_crash_between_two_outputs_leaves_no_skew(spark, tmp_path):
    rows = spark.createDataFrame([(1, 300, 0, 5, 1, 9, 2, "a")], STORED)
    follower = follower_of_numbers(spark, tmp_path)
    # the counts of batch 0 were never written, so nobody sees its rows
    follower.tables.append("deployments", rows.withColumn("block_part", F.lit(0).cast("long")), TICK, "block_part")
    assert follower.deployments().count() == 0
    follower.ingest(rows, 0)
    assert follower.deployments().count() == 1 and follower.block_counts().first().contract_count == 1


def test_removing_and_rebuilding_sources(spark, tmp_path):
    a, b_ = [(1, 300, 0, 5, 1, 9, 2, "a"), (1, 301, 0, 6, 1, 9, 2, "a")], [(1, 301, 0, 6, 1, 9, 2, "b"), (1, 302, 0, 7, 1, 8, 3, "b"), (2, 5, 0, 7, 1, None, None, "b")]
    follower, rows = follower_of_numbers(spark, tmp_path), spark.createDataFrame(a + b_, STORED)
    files = lambda *x: spark.createDataFrame([(n,) for n in x], "source_path string")
    read = lambda new: rows.join(new, "source_path", "left_semi")
    gone = lambda *x: [r.source_path for r in follower.sync(files(*x), read).collect()]
    assert gone("a") == [] and gone("a", "b") == []
    blocks = lambda: {r.block_number: r.contract_count for r in follower.block_counts().collect()}
    codes = lambda: {r.code_hash: r.contract_count for r in follower.code_counts().collect()}
    assert blocks() == {300: 1, 301: 1, 302: 1, 5: 1} and codes() == {9: 2, 8: 1}
    follower.remove_source("a")
    assert blocks() == {302: 1, 5: 1} and codes() == {8: 1} and {r.source_path for r in follower.sources().collect()} == {"b"}
    assert {r.block_number for r in follower.deployments().collect()} == {302, 5}
    follower.compact()
    assert blocks() == {302: 1, 5: 1} and {r.code_hash for r in follower.bucket_code_counts().collect()} == {8}
    assert gone("a", "b") == [] and blocks() == {300: 1, 301: 1, 302: 1, 5: 1}
    assert gone("b") == ["a"]
    again = follower_of_numbers(spark, tmp_path)
    assert {r.block_number: r.contract_count for r in again.block_counts().collect()} == {301: 1, 302: 1, 5: 1}
    assert not again.backfill()


def test_contract_files_of_binary_keys(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    def write(name, chain, blocks, fill):
        n = len(blocks)
        same = lambda size, x: pa.array([bytes([x]) * size] * n, pa.binary(size))
        columns = {
            "block_number": pa.array(blocks, pa.uint32()), "block_hash": same(32, fill), "create_index": pa.array([0] * n, pa.uint32()), "transaction_hash": same(32, fill),
            "contract_address": same(20, fill + 2), "deployer": same(20, fill + 3), "factory": pa.nulls(n, pa.binary(20)), "init_code": pa.array([b"\x60\x00"] * n, pa.binary()),
            "code": pa.array([b"\x5f\x00"] * n, pa.binary()), "init_code_hash": same(32, fill), "n_init_code_bytes": pa.array([2] * n, pa.uint32()), "n_code_bytes": pa.array([2] * n, pa.uint32()),
            "code_hash": same(32, fill + 6), "chain_id": pa.array([chain] * n, pa.uint64()),
        }
        (tmp_path / "in").mkdir(exist_ok=True)
        pq.write_table(pa.table(columns), tmp_path / "in" / name)

    follower = Follower(spark, f"file://{tmp_path}/out", confirmations=0)
    write("contracts__chain_0000000001__0000000300__0000000400.parquet", 1, [300, 350], 1)
    write("contracts__chain_0000000100__0000000300__0000000400.parquet", 100, [300], 1)
    follower.run(str(tmp_path / "in")).awaitTermination()
    write("contracts__chain_0000000001__0000000350__0000000500.parquet", 1, [350, 500], 1)
    follower.run(str(tmp_path / "in")).awaitTermination()
    assert {(r.chain_id, r.block_number, r.contract_count) for r in follower.block_counts().collect()} == {(1, 300, 1), (1, 350, 1), (1, 500, 1), (100, 300, 1)}
    assert {(r.chain_id, bytes(r.code_hash), r.contract_count) for r in follower.code_counts().collect()} == {(1, bytes([7]) * 32, 3), (100, bytes([7]) * 32, 1)}
    assert [r.uses_push0 for r in follower.metadata().collect()] == [True]
    assert {r.source_path.split("__")[2]: r.rows for r in follower.sources().filter("source_path like '%chain_0000000001%'").collect()} == {"0000000300": 2, "0000000350": 1}
    assert {r.chain_id: r["head"] for r in follower.heads().collect()} == {1: 500, 100: 300}


def test_tolerant_reading(spark, tmp_path):
    spark.createDataFrame([(5, bytearray(b"x" * 20), bytearray(b"\x60\x00"))], "block_number int, contract_address binary, code binary").write.parquet(f"{tmp_path}/one.parquet")
    spark.createDataFrame([(6, bytearray(b"y" * 20), 7)], "block_number int, contract_address binary, n_code_bytes int").write.parquet(f"{tmp_path}/two.parquet")
    got = {r.block_number: (r.chain_id, r.create_index, r.n_code_bytes) for r in contracts.normalized(contracts.read_union(spark, str(tmp_path))).collect()}
    assert got == {5: (1, 0, 2), 6: (1, 0, 7)}
    with pytest.raises(ValueError, match="block_number"):
        contracts.normalized(spark.createDataFrame([(1,)], "contract_address long"))


def test_file_names(spark):
    names = ["contracts__chain_0000000100__0000000005__0000000009.parquet", "tail__chain_0000000001__0000000010__0000000011.parquet", "contracts__0000000001__0000000500.parquet", "x.parquet"]
    got = {r.name[:5] + str(r.chain_id): r.end_block for r in contracts.file_spans(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {"contr100": 9, "tail_1": 11, "contr1": 500}


def test_duplicate_labels_count_once(spark):
    rows = spark.createDataFrame([(1, 10, 0, 5), (1, 11, 0, 6)], "chain_id long, block_number long, create_index long, contract_address long")
    labels = spark.createDataFrame([(1, 5, True), (1, 5, True), (1, 6, False), (1, 99, True)], "chain_id long, contract_address long, is_verified boolean")
    r = analytics.stats(rollups.block_counts(rows), rows, labels).first()
    assert (r.total_contracts, r.verified_count, r.unverified_count, r.verified_pct) == (2, 1, 1, 50.0)


def test_first_import_reads_all_files(spark):
    listing = spark.createDataFrame([("v1", 1, 1, False), ("v2", 1, 1, False), ("d", 1, 1, True)], "path string, length long, modified long, is_deployment boolean")
    changed = lambda m: {r.path for r in verification.changed_files(listing, m).collect()}
    assert changed(listing.limit(0)) == {"v1", "v2"}
    assert changed(listing) == set()
    assert changed(listing.withColumn("modified", F.expr("if(path = 'd', 0, modified)"))) == {"v1", "v2"}
    assert changed(listing.withColumn("modified", F.expr("if(path = 'v2', 0, modified)"))) == {"v2"}


def test_ad_hoc_is_bounded_and_read_only(spark):
    wide = spark.createDataFrame([(1, 5), (100, 6)], "chain_id long, block_number long")
    run = lambda text, **k: explorer.ad_hoc(spark, text, {"contract_metadata": wide}, **k)
    assert [r.block_number for r in run("select * from contract_metadata", chain=100).collect()] == [6]
    assert run("with t as (select * from contract_metadata) select * from t", limit=-4).count() == 1
    for text in ("drop view contract_metadata", "select 1; select 2", "set spark.x=1", "select * from parquet.`/root/testdata/sf0.001/part.parquet`"):
        with pytest.raises(Exception):  # noqa: B017
            run(text).collect()


def test_swap_keeps_the_old_version_for_readers(spark, tmp_path):
    tables = Tables(spark, f"file://{tmp_path}/t")
    old = tables.swap("x", spark.range(3))
    tables.swap("x", spark.range(5))
    assert old.count() == 3 and tables.read("x", None).count() == 5
    assert tables.read("none", "id long").count() == 0


def test_old_generation_is_padded(spark):
    new = spark.createDataFrame([(1, 5, True)], "chain_id long, contract_address long, is_erc20 boolean")
    old = spark.createDataFrame([(1, 5, "x"), (1, 6, "y")], "chain_id long, contract_address long, language string")
    got = sorted((r.contract_address, r.is_erc20, r.language) for r in decode.addresses_across_generations(new, old).collect())
    assert got == [(5, True, None), (6, False, "y")]


def test_landed_traces_keep_order(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"chain_id":1,"block_number":2,"traces":[{"type":"call","action":{"from":"0x1"},"traceAddress":[]},{"type":"create","action":{"from":"0x2"},"traceAddress":[0]}]}\n')
    assert [(r.pos, r.trace.type) for r in landed.traces(spark, str(tmp_path)).collect()] == [(0, "call"), (1, "create")]


def test_wide_table_is_rebuilt_only_when_needed(spark, tmp_path):
    deployments = lambda *blocks: spark.createDataFrame([(1, x, 0, x, 7, 100) for x in blocks], "chain_id long, block_number long, create_index long, contract_address long, code_hash long, n_code_bytes long")
    flags = {f: False for f in decode.FLAGS}
    meta = spark.createDataFrame([{"code_hash": 7, "language": "solidity", "compiler_version": "0.8", "decoded_at": 1, **flags}], "code_hash long, language string, compiler_version string, decoded_at long, " + ", ".join(f"{f} boolean" for f in decode.FLAGS))
    labels = lambda *rows: spark.createDataFrame(list(rows), "chain_id long, contract_address long, is_verified boolean, contract_name string, match_type string, block_number long")
    one, wide = labels((1, 10, True, None, "runtime", 10)), jobs.WideTable(spark, f"file://{tmp_path}/wide")
    assert wide.refresh(deployments(10, 20), meta, one) and not wide.refresh(deployments(10, 20), meta, one)
    assert not wide.refresh(deployments(10, 20, 30), meta, one)
    assert wide.served(deployments(10, 20, 30), meta).filter("is_decoded").count() == 3
    assert wide.refresh(deployments(10, 15, 20, 30), meta, one)
    assert wide.refresh(deployments(10, 15, 20, 30), meta, labels((1, 10, True, None, "runtime", 10), (1, 20, True, None, "runtime", 20)))
    assert wide.table("wide").filter("is_verified").count() == 2 and wide.table("bounds").first().bound == 30
    wide.next().put("bounds", deployments(1))  # a build that died before its mark
    assert wide.table("wide").count() == 4


def test_registry_is_updated_and_repaired(spark, tmp_path):
    deployed = spark.createDataFrame([(1, 1, 11, 5, 0, "d"), (2, 1, 12, 6, 0, "d"), (3, 1, 13, 7, 0, "d")], "id long, chain_id long, address long, block_number long, transaction_index long, file string")
    verified = spark.createDataFrame([(1, 100, "v1"), (2, 100, "v2"), (3, 100, "v2")], "deployment_id long, created_at long, file string")
    verified = verified.withColumns({c: F.lit(True) for c in ("runtime_match", "creation_match", "runtime_metadata_match", "creation_metadata_match")})
    listing = lambda *names: spark.createDataFrame([(n, 1, 1, n == "d") for n in names], "path string, length long, modified long, is_deployment boolean")
    registry = jobs.Registry(spark, f"file://{tmp_path}/registry", 1)
    addresses = lambda: {r.contract_address for r in registry.table("labels").collect()}
    assert registry.refresh(listing("d", "v1"), deployed, verified.filter("file = 'v1'"), 0) == "imported" and addresses() == {11}
    assert registry.refresh(listing("d", "v1", "v2"), deployed, verified, 0) == "updated" and addresses() == {11, 12, 13}
    assert registry.refresh(listing("d", "v1", "v2"), deployed, verified, 0) == "unchanged"
    broken = registry.table("labels").filter("contract_address <> 12")
    state = registry.table("state").first()
    parts = broken.select(jobs._label_part("contract_address").alias("label_part")).unionByName(registry.table("labels").select(jobs._label_part("contract_address").alias("label_part"))).distinct()
    labels = registry.labels.replace(state.labels, broken.withColumn("label_part", jobs._label_part("contract_address")), parts)
    new = registry.next()
    for name in ("manifest", "imports"):
        new.put(name, registry.table(name))
    new.put("state", spark.createDataFrame([(labels, state.lineage)], "labels long, lineage long"))
    new.mark()
    assert addresses() == {11, 13}
    assert registry.refresh(listing("d", "v1", "v2"), deployed, verified, 0) == "repaired" and addresses() == {11, 12, 13}
    assert registry.refresh(listing("d", "v1"), deployed, verified.filter("file = 'v1'"), 0) == "updated" and addresses() == {11}


def test_presented_keeps_the_sign_of_what_rounds_to_zero(spark):
    rows = spark.createDataFrame([(1, -0.0), (2, -0.003), (3, 0.0), (4, -999.85), (5, None)], "k long, price double").withColumn("d", F.expr("cast(k as decimal(12,2))"))
    got = [r.row for r in explorer.presented(rows, {"price": 2}).collect()]
    prices = ['"-0.00"', '"-0.00"', '"0.00"', '"-999.85"', "null"]
    assert got == [f'{{"k":{k},"price":{p},"d":"{k}.00"}}' for k, p in enumerate(prices, 1)]

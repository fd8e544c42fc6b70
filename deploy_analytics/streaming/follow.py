"""Following the head: landed files become deployments, counts, code and metadata, micro-batch by micro-batch.

All outputs of a batch carry its number. The table of heads is written last, and a
batch counts once it is there, so readers see all of a batch or nothing, and a batch
that counts isn't run again. Late files below the head are counted in place. Rows that
lack confirmations are state: a table ``held`` that the last batch to change it has
written, and that merges hand on.

Counts are additive: removing a source appends the negative counts of its rows and a
tombstone that hides them in older segments; a merge drops the rows. Deployments lie
in partitions of many block buckets, sorted by block, and a batch is compared with the
partitions that it touches. Code is stored once a hash, with what decoding found, in
parts by a hash of the hash; a batch looks only into the parts of its own hashes.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime
from time import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas, tables
from ..functions import bytecode
from ..operators import blocktime, decode, rollups
from ..sources import contracts
from ..tables import GRACE, Segment, Segments, Tables, segment_last, together

CONFIRMATIONS = 12
FILES_A_TICK = 1000
TICK = 1_000_000  #: numbers from one micro-batch to the next; those between are for batches that no stream brings
PART_BUCKETS = 100  #: block buckets of a partition of deployments
MANY_PARTS = 1000  #: partitions by which a comparison is pruned one by one; beyond, by their span
HASH_PARTS = 64  #: of the stores of code and metadata


def hash_part(column: str = "code_hash"):
    return F.pmod(F.xxhash64(column), F.lit(HASH_PARTS)).cast("int").alias("hash_part")


class Follower:
    """Stored deployments with their counts, and code with its metadata where rows bring it (a column code).

    kind is the type of addresses and hashes; it is binary in contract files, and these
    bring code. headers gives block headers (chain_id, block_number, block_timestamp);
    with it a batch stores the time of a head that is a day's blocks past the last
    checkpoint of its chain.
    """

    def __init__(self, spark: SparkSession, root: str, confirmations: int = CONFIRMATIONS, width: int = rollups.BUCKET_BLOCKS, kind: str = "binary", with_code: bool = True,
                 headers: Callable[[], DataFrame] | None = None, fanout: int = tables.FANOUT, grace: float = GRACE):
        self.spark, self.home, self.confirmations, self.width, self.kind = spark, root, confirmations, width, kind
        self.headers, self.fanout, self.grace = headers, fanout, grace
        self.schema, self.code_type = schemas.stored(kind), f"code_hash {kind}, code binary"
        self.brought, self.with_code = self.schema + ", code binary" * with_code, with_code  # what a batch brings
        self.columns = [c for c in tables.empty(spark, self.brought).columns if c != "code"]
        self.generations = Tables(spark, root)
        self._open(max(self.generations.committed("generation"), default=0))

    def _open(self, generation: int) -> None:
        self.tables = Segments(self.spark, f"{self.home}/generation={generation}", "heads", self.fanout)

    # -- what is stored

    def _table(self, name: str, schema: str, segments: list[Segment] | None = None) -> DataFrame:
        return self.tables.rows(name, schema, self.tables.cover() if segments is None else segments)

    def deployments(self, segments: list[Segment] | None = None) -> DataFrame:
        """Stored rows, with block_part, without those of removed sources."""
        segments = self.tables.cover() if segments is None else segments
        rows = self._table("deployments", self.schema + ", block_part long, segment string", segments)
        if not self.tables.present("removed", segments):
            return rows.drop("segment")
        gone = self._table("removed", schemas.REMOVED, segments).groupBy("source_path").agg(F.max("upto").alias("upto"))
        met = rows.withColumn("_last", segment_last()).alias("r").join(gone.alias("g"), F.expr("r.source_path = g.source_path and r._last <= g.upto"), "left_anti")
        return met.drop("segment", "_last")

    def block_counts(self) -> DataFrame:
        return rollups.summed(self._table("block_counts", schemas.BLOCK_COUNTS))

    def code_counts(self) -> DataFrame:
        return rollups.summed(self._table("code_counts", schemas.code_counts(self.kind)))

    def bucket_code_counts(self) -> DataFrame:
        return rollups.summed(self._table("bucket_code_counts", schemas.bucket_code_counts(self.kind)))

    def codes(self, segments: list[Segment] | None = None) -> DataFrame:
        """(code_hash, code, hash_part): each code once."""
        return self._table("codes", self.code_type + ", hash_part int", segments)

    def metadata(self) -> DataFrame:
        """What decoding found, by code hash."""
        return self._table("metadata", schemas.metadata(self.kind))

    def held(self, segments: list[Segment] | None = None) -> DataFrame:
        """Rows that lack confirmations: those of the last segment that has any such table."""
        segments = self.tables.cover() if segments is None else segments
        return self.tables.rows("held", self.brought, self.tables.present("held", segments)[-1:])

    def source_slices(self) -> DataFrame:
        """(source_path, block_part, start_block, end_block, rows) of every source and partition of blocks."""
        return self._source_sums("source_path", "block_part").drop("live")

    def _source_sums(self, *keys: str) -> DataFrame:
        found = self._table("sources", schemas.SOURCES).groupBy(*keys)
        return found.agg(F.min("start_block").alias("start_block"), F.max("end_block").alias("end_block"), F.sum("rows").alias("rows"), F.sum("live").alias("live")).filter("live > 0")

    def sources(self) -> DataFrame:
        """(source_path, start_block, end_block, rows) of every source that was taken in and not removed since; rows are those it brought first."""
        return self._source_sums("source_path").drop("live")

    def heads(self, segments: list[Segment] | None = None) -> DataFrame:
        """(chain_id, head): a few rows for each segment."""
        return self._table("heads", schemas.HEADS, segments).groupBy("chain_id").agg(F.max("head").alias("head"))

    def checkpoints(self) -> DataFrame:
        """(chain_id, block_number, block_timestamp) of the heads whose time was stored."""
        return blocktime.latest_checkpoints(self._table("checkpoints", schemas.CHECKPOINTS))

    # -- one batch

    def ingest(self, rows: DataFrame, batch: int) -> None:
        """One micro-batch of the stream: rows and those held back before, up to the head less the confirmations."""
        self.take(rows, TICK * (batch + 1))
        self.settle()

    def take(self, rows: DataFrame, number: int, confirmations: int | None = None, codes: DataFrame | None = None) -> None:
        """Rows of the stored schema (and code, unless codes has it) as batch number; nothing happens if the batch counts already."""
        if self.tables.has(number):
            return
        confirmations = self.confirmations if confirmations is None else confirmations
        segments = self.tables.cover()
        bring = self.columns + ["code"] * (self.with_code and codes is None)
        rows = rollups.complete(rows).select(*bring)
        if confirmations:
            rows = rows.unionByName(self.held(segments), allowMissingColumns=True)
        own = rows.groupBy("chain_id").agg(F.max("block_number").alias("head"))
        heads = own.unionByName(self.heads(segments)).groupBy("chain_id").agg(F.max("head").alias("head"))
        heads = self.tables.append("work_heads", heads, number)
        if confirmations:
            rows = rows.join(F.broadcast(heads), "chain_id")  # a row for each chain
            safe = F.col("block_number") <= F.col("head") - confirmations
            late = rows.filter(~safe).drop("head").dropDuplicates([*rollups.KEY, "source_path"])
            rows = rows.filter(safe).drop("head")
        part = F.expr(f"block_number div {self.width * PART_BUCKETS}").alias("block_part")
        staged = self.tables.append("work_staged", rollups.dedup_batch(rows.select(*self.columns)).select(*self.columns, part), number)
        fresh = self._fresh(staged, segments, number)
        jobs = [lambda: self._counts(fresh, number), lambda: self._sources(staged, fresh, number)]
        if confirmations:
            jobs.append(lambda: self.tables.append("held", late, number))
        if self.with_code:
            jobs.append(lambda: self._codes(staged, rows if codes is None else codes, segments, number))
        if self.headers:
            jobs.append(lambda: self._checkpoints(heads, number))
        together(*jobs)
        self.tables.append("heads", heads, number)  # from here on the batch counts
        for work in ("work_heads", "work_staged", "work_codes"):
            self.tables.delete(f"{work}/{Segment(number, number).folder}")

    def _fresh(self, staged: DataFrame, segments: list[Segment], number: int) -> DataFrame:
        """The batch's rows that no segment has, stored."""
        touched = staged.groupBy("block_part").agg(F.min("block_number").alias("low"), F.max("block_number").alias("high")).collect()
        rows = staged
        if touched and segments:
            parts = [r.block_part for r in touched]
            near = self.deployments(segments)
            near = near.filter(F.col("block_part").isin(parts) if len(parts) <= MANY_PARTS else F.col("block_part").between(min(parts), max(parts)))
            near = near.filter(F.col("block_number").between(min(r.low for r in touched), max(r.high for r in touched)))
            rows = staged.join(near.select(*rollups.KEY), rollups.KEY, "left_anti")
        # dealt by block, so that a task writes files of few partitions and not one of each
        dealt = rows.repartitionByRange("block_part", "block_number").sortWithinPartitions("block_part", "block_number")
        return self.tables.append("deployments", dealt, number, "block_part")

    def _counts(self, fresh: DataFrame, number: int, change=lambda df: df) -> None:
        """Partial counts of a batch's new rows; the counts by code are those by bucket added up."""

        def by_code():
            by_bucket = self.tables.append("bucket_code_counts", change(rollups.bucket_code_counts(fresh, self.width)), number)
            sums = by_bucket.groupBy("chain_id", "code_hash").agg(F.sum("contract_count").alias("contract_count"), F.max("n_code_bytes").alias("n_code_bytes"))
            self.tables.append("code_counts", sums, number)

        together(by_code, lambda: self.tables.append("block_counts", change(rollups.block_counts(fresh)), number))

    def _sources(self, staged: DataFrame, fresh: DataFrame, number: int) -> None:
        keys = ["source_path", "block_part"]
        span = staged.groupBy(*keys).agg(F.min("block_number").alias("start_block"), F.max("block_number").alias("end_block"))
        span = span.join(fresh.groupBy(*keys).agg(F.count("*").alias("n")), keys, "left")
        self.tables.append("sources", span.select(*keys, "start_block", "end_block", F.coalesce("n", F.lit(0).cast("long")).alias("rows"), F.lit(1).cast("long").alias("live")), number)

    def unknown_hashes(self, staged: DataFrame, segments: list[Segment]) -> DataFrame:
        """(code_hash) of a batch that the store lacks; only parts that may hold one are read."""
        hashes = staged.filter("code_hash is not null").select("code_hash").distinct()
        if self.kind == "binary":
            hashes = hashes.filter(F.octet_length("code_hash") == 32)
        if not self.tables.present("codes", segments):
            return hashes
        parts = [r.hash_part for r in hashes.select(hash_part()).distinct().collect()]  # at most HASH_PARTS
        return hashes.join(self.codes(segments).filter(F.col("hash_part").isin(parts)).select("code_hash"), "code_hash", "left_anti")

    def _codes(self, staged: DataFrame, rows: DataFrame, segments: list[Segment], number: int) -> None:
        """Store the code of hashes that are seen for the first time, and what decoding finds. Only their code is shuffled."""
        unknown = self.tables.append("work_codes", self.unknown_hashes(staged, segments), number)
        code = rows.filter("code is not null").select("code_hash", "code").join(unknown, "code_hash", "left_semi")
        code = code.groupBy("code_hash").agg(F.min("code").alias("code")).withColumn("hash_part", hash_part())
        new = self._by_hash("codes", code, Segment(number, number))
        now = datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")
        found = bytecode.analyzed(new.filter(F.octet_length("code").between(1, decode.MOST)))
        self._by_hash("metadata", found.select("code_hash", *decode.FOUND, F.lit(now).cast("timestamp").alias("decoded_at"), "hash_part"), Segment(number, number))

    def _by_hash(self, name: str, rows: DataFrame, segment: Segment) -> DataFrame:
        return self.tables.write(name, rows.sortWithinPartitions("hash_part", "code_hash"), segment, "hash_part")

    def _checkpoints(self, heads: DataFrame, number: int) -> None:
        """The time of heads that are due, where a header gives it; the headers are read only if one is."""
        due = blocktime.due_checkpoints(heads, self.checkpoints()).filter("due").select("chain_id", F.col("head").alias("block_number"))
        if due.isEmpty():
            return
        found = self.headers().join(F.broadcast(due), ["chain_id", "block_number"]).filter("block_timestamp > 0")  # a row for each chain
        self.tables.append("checkpoints", found.select("chain_id", "block_number", "block_timestamp", F.lit(number).cast("long").alias("observed_at")), number)

    # -- sources

    def _next(self) -> int:
        number = max([0, *(s.last for s in self.tables.cover())]) + 1
        if number % TICK == 0:
            raise RuntimeError(f"{TICK - 1} batches lie between two of the stream; let it run once")
        return number

    def remove_source(self, source: str) -> None:
        """Take a source's rows and its share of all counts away, also what is held, and forget it. Rows that another source brought first stay that one's."""
        segments, number = self.tables.cover(), self._next()
        own = F.col("source_path") == source
        gone = self.tables.append("work_staged", self.deployments(segments).filter(own), number)
        forgotten = self._table("sources", schemas.SOURCES, segments).filter(own).withColumns({"rows": -F.col("rows"), "live": -F.col("live")})
        jobs = [lambda: self._counts(gone, number, rollups.negated), lambda: self.tables.append("sources", forgotten, number)]
        jobs.append(lambda: self.tables.append("removed", self.spark.createDataFrame([(source, number - 1)], schemas.REMOVED), number))
        if self.tables.present("held", segments):
            jobs.append(lambda: self.tables.append("held", self.held(segments).filter(~F.coalesce(own, F.lit(False))), number))
        together(*jobs)
        self.tables.append("heads", self.heads(segments), number)
        self.tables.delete(f"work_staged/{Segment(number, number).folder}")

    def replace_source(self, source: str, rows: DataFrame) -> None:
        """The source's rows anew, as when a file is written again."""
        self.remove_source(source)
        self.take(rows.withColumn("source_path", F.lit(source)), self._next())

    def load(self, source: str, snapshot: DataFrame, bytecodes: DataFrame, again: bool = False) -> bool:
        """A whole normalized snapshot as one batch; its span is recorded by partition of blocks. Returns whether it was taken in.

        A source that is there already is left alone, or replaced by what the snapshot
        says now. A snapshot is old, so none of it waits for confirmations. Code comes
        from bytecodes (code_hash, n_code_bytes and, if code is stored, code), so it isn't
        copied to each deployment.
        """
        if not self.sources().filter(F.col("source_path") == source).isEmpty():
            if not again:
                return False
            self.remove_source(source)
        rows = rollups.snapshot_deployments(snapshot, bytecodes).withColumn("source_path", F.lit(source))
        rows = rows.withColumn("create_index", F.coalesce(F.col("create_index").cast("long"), F.lit(0).cast("long"))).withColumn("n_code_bytes", F.col("n_code_bytes").cast("long"))
        self.take(rows, self._next(), 0, bytecodes.select("code_hash", "code") if self.with_code else None)
        self.settle()
        return True

    def sync(self, files: DataFrame, read) -> DataFrame:
        """Bring the tables in line with files (source_path): new ones are taken in; if one vanished, all is built anew.

        read gives the rows of a table of source paths. Returns the sources that vanished (source_path).
        """
        self._drop_generations()
        gone = self.generations.put(f"vanished/before={max(self.generations.committed('generation'), default=0)}", rollups.vanished(files, self.sources()).select("source_path"))
        rebuilt = not gone.isEmpty()
        if rebuilt:
            self._open(max(self.generations.committed("generation"), default=0) + 1)
        new = rollups.untracked(files, self.sources())
        if not new.isEmpty():
            self.take(read(new), self._next())
        if rebuilt:
            self.tables.mark()  # readers turn to the new generation now
        return gone

    def _drop_generations(self) -> None:
        """Delete what the current generation has replaced for grace seconds."""
        marked = {int(name.partition("=")[2]): at for name, at in self.generations._marked("generation=*")}
        if marked and marked[max(marked)] <= time() - self.grace:
            for name, _ in self.generations._names("generation=*"):
                if int(name.partition("=")[2]) < max(marked):
                    self.generations.delete(name)

    def backfill(self) -> bool:
        """Counts by bucket and code from the stored rows, only where there are none yet."""
        if not self._table("bucket_code_counts", schemas.bucket_code_counts(self.kind)).isEmpty() or self.deployments().isEmpty():
            return False
        number = self._next()
        self.tables.append("bucket_code_counts", rollups.bucket_code_counts(self.deployments(), self.width), number)
        self.tables.append("heads", self.heads(), number)
        return True

    # -- levels

    def settle(self) -> None:
        """Merge what is due, level by level, and delete what was merged long ago."""
        merged = False
        while due := self.tables.due():
            self._merge(due)
            merged = True
        if merged or self.grace == 0:
            self.tables.clean(self.grace)

    def compact(self) -> None:
        """Let one segment stand for all batches so far."""
        segments = self.tables.cover()
        if len(segments) > 1 or (segments and self.tables.present("removed", segments)):
            self._merge(segments)

    def _merge(self, group: list[Segment]) -> None:
        """One segment instead of some neighbouring ones. Negative counts and tombstones stay while older segments may need them."""
        new = Segment(group[0].first, group[-1].last, max(s.level for s in group) + 1)
        oldest = self.tables.cover()[0].first == group[0].first
        write, read = self.tables.write, lambda name, schema: self.tables.rows(name, schema, group)
        have = lambda name: bool(self.tables.present(name, group))
        jobs = []

        def counted(name: str, schema: str):
            write(name, rollups.partials(read(name, schema)), new)

        def located(name: str, schema: str):
            rows = read(name, schema + ", hash_part int")
            self._by_hash(name, rows.repartitionByRange("hash_part", "code_hash"), new)

        for name, schema in (("block_counts", schemas.BLOCK_COUNTS), ("code_counts", schemas.code_counts(self.kind)), ("bucket_code_counts", schemas.bucket_code_counts(self.kind))):
            if have(name):
                jobs.append(lambda name=name, schema=schema: counted(name, schema))
        for name, schema in (("codes", self.code_type), ("metadata", schemas.metadata(self.kind))):
            if have(name):
                jobs.append(lambda name=name, schema=schema: located(name, schema))
        # a partition of blocks may be split over several tasks and files
        kept = self.deployments(group).repartitionByRange("block_part", "block_number").sortWithinPartitions("block_part", "block_number")
        jobs.append(lambda: write("deployments", kept, new, "block_part"))
        known = read("sources", schemas.SOURCES).groupBy("source_path", "block_part").agg(F.min("start_block").alias("start_block"), F.max("end_block").alias("end_block"), F.sum("rows").alias("rows"), F.sum("live").alias("live"))
        jobs.append(lambda: write("sources", known.filter("live <> 0 or rows <> 0"), new))
        if have("held"):
            jobs.append(lambda: write("held", self.held(group), new))
        if have("checkpoints"):
            jobs.append(lambda: write("checkpoints", read("checkpoints", schemas.CHECKPOINTS), new))
        if have("removed") and not oldest:
            hidden = read("removed", schemas.REMOVED).withColumn("upto", F.least("upto", F.lit(group[0].first - 1)))
            jobs.append(lambda: write("removed", hidden.distinct(), new))
        together(*jobs)
        write("heads", self.heads(group), new)

    # -- the stream

    def landed(self, folder: str, files_a_tick: int = FILES_A_TICK) -> DataFrame:
        """The stream of a folder's rows: of contract files, whose names are their sources, or of stored rows."""
        schema = schemas.CONTRACT_FILE if self.kind == "binary" else self.brought
        rows = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_tick).parquet(folder)
        if "source_path" in rows.columns:
            return rows
        return contracts.normalized(rows.withColumn("source_path", F.col("_metadata.file_name")), "code")

    def run(self, landed: str, every: str | None = None, files_a_tick: int = FILES_A_TICK):
        """Start the query on a folder of landed Parquet files: once over what is there, or at an interval.

        A tick takes so many files at most; where the next one goes on is in the checkpoint.
        """
        writer = self.landed(landed, files_a_tick).writeStream.foreachBatch(self.ingest).option("checkpointLocation", f"{self.home}/progress")
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def live_bucket_counts(rows: DataFrame, width: int) -> DataFrame:
    """Counts per block bucket of a stream (or a table) of deployments."""
    return rows.groupBy("chain_id", rollups.bucket(width).alias("bucket_id")).agg(F.count("*").alias("count"))


class LiveCounts:
    """The latest counts of a stream in update mode: a trigger writes the keys that it changed, and no others.

    Each trigger is a segment; a reader takes the last row of a key. Segments are merged
    level by level, so a key that stays is written again as often as there are levels. A
    trigger that is run again after a failure writes its own segment anew.
    """

    STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    KEYS = ["chain_id", "bucket_id"]
    SCHEMA = "chain_id long, bucket_id long, count long"

    def __init__(self, spark: SparkSession, root: str, fanout: int = tables.FANOUT, grace: float = GRACE):
        self.spark, self.grace = spark, grace
        self.tables = Segments(spark, root, "counts", fanout)

    def _latest(self, segments: list[Segment]) -> DataFrame:
        rows = self.tables.rows("counts", self.SCHEMA + ", segment string", segments).withColumn("at", segment_last())
        return rows.groupBy(*self.KEYS).agg(F.max_by("count", "at").alias("count"))

    def table(self) -> DataFrame:
        """(chain_id, bucket_id, count)."""
        return self._latest(self.tables.cover())

    def update(self, changed: DataFrame, batch: int) -> None:
        if self.tables.has(batch):
            return
        self.tables.append("counts", changed.select(*self.KEYS, "count"), batch)
        while due := self.tables.due():
            self.tables.write("counts", self._latest(due), Segment(due[0].first, due[-1].last, due[0].level + 1))
            self.tables.clean(self.grace)

    def start(self, counts: DataFrame, progress: str):
        """Start the query over live_bucket_counts of a stream, its state in RocksDB on the executors, checkpointed in progress."""
        key, before = "spark.sql.streaming.stateStore.providerClass", self.spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
        self.spark.conf.set(key, self.STORE)
        try:  # a query keeps the setting that it was started with
            writer = counts.writeStream.outputMode("update").foreachBatch(self.update).option("checkpointLocation", progress)
            return writer.trigger(availableNow=True).start()
        finally:
            self.spark.conf.unset(key) if before is None else self.spark.conf.set(key, before)

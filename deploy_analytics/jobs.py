"""Refresh jobs over stored tables: the wide table, the labels of a registry, and metadata of contract files.

Each keeps numbered versions. A state written last says which versions of its tables
belong together, so readers see one state or the other, and a job that died halfway
leaves nothing behind that counts. Tables are in parts, and a run reads and writes the
parts that something changed in.
"""

from __future__ import annotations

from collections.abc import Callable
from time import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions import bytecode
from .operators import decode, explorer, rollups, verification
from .tables import GRACE, Parts, Segments, Tables, checksum

LABEL_PARTS = 64  #: of the labels of a chain, by address


class _Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.all = spark, root, Tables(spark, root)

    def current(self) -> Tables | None:
        found = self.all.committed("version")
        return Tables(self.spark, f"{self.root}/version={found[-1]}") if found else None

    def next(self) -> Tables:
        return Tables(self.spark, f"{self.root}/version={max(self.all.committed('version'), default=0) + 1}")

    def table(self, name: str) -> DataFrame:
        now = self.current()
        if now is None:
            raise LookupError("nothing was built yet")
        return self.spark.read.parquet(f"{now.root}/{name}")

    def _in_parts(self) -> dict[str, Parts]:
        """The tables in parts, by the name under which the state notes their versions."""
        return {}

    def clean(self, grace: float = GRACE) -> None:
        """Delete what no reader needs: states before the current one, and parts that only they used, once it is older than grace seconds."""
        marked = {int(name.partition("=")[2]): at for name, at in self.all._marked("version=*")}
        if not marked or marked[max(marked)] > time() - grace:
            return
        for name, parts in self._in_parts().items():
            parts.clean(self._noted(name), grace)
        for number in set(marked) - {max(marked)}:
            self.all.delete(f"version={number}")

    def _noted(self, name: str) -> int | None:
        """The version of a table in parts that the current state goes with."""
        return None if self.current() is None else self.table("state").first()[name]


class WideTable(_Versions):
    """The wide table in parts by chain and block bucket, with the span of each chain and a mark of what it was built from.

    Checksums of a bucket's deployments and of its wide rows, which don't depend on
    order, say what a refresh has to write.
    """

    KEYS = ["chain_id", "block_bucket"]

    def __init__(self, spark: SparkSession, root: str, width: int = rollups.BUCKET_BLOCKS):
        super().__init__(spark, root)
        self.width, self.parts = width, Parts(spark, f"{root}/wide", *self.KEYS, folders=["chain_id"])

    def table(self, name: str) -> DataFrame:
        return self.parts.rows(self._noted("wide")).drop("block_bucket") if name == "wide" else super().table(name)

    def _in_parts(self) -> dict[str, Parts]:
        return {"wide": self.parts}

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("block_bucket", rollups.bucket(self.width))

    def _sums(self, deployments: DataFrame) -> DataFrame:
        return self._bucketed(deployments).groupBy(*self.KEYS).agg(*checksum(*deployments.columns))

    def _wide_sums(self, wide: DataFrame) -> DataFrame:
        n, hashes = checksum(*wide.columns)
        return wide.groupBy(*self.KEYS).agg(n.alias("wide_n"), hashes.alias("wide_hashes"))

    def refresh(self, deployments: DataFrame, meta: DataFrame, labels: DataFrame, loaded: bool = True) -> int:
        """Bring the table in line with its inputs, where metadata or labels changed, or deployments at or below the bounds, or a chain is new.

        Deployments above the bounds are served from their own table and call for
        nothing. Returns how many buckets were written. They are those whose deployments
        changed, and those with an address whose label the chain's span took in or left
        out since; if metadata or labels changed, those whose wide rows differ. The
        result is that of building everything anew.
        """
        mark, base = explorer.input_mark(meta, labels), self._noted("wide")
        spans = rollups.indexed_range(deployments)
        wide = lambda rows: self._bucketed(explorer.wide_table(rows, meta, labels, loaded, spans))
        if base is None:
            changed, gone = self._sums(deployments).select(*self.KEYS), None
        else:
            before, bound = self.parts.manifest(base), self.table("bounds")
            gone = None
            if mark.join(self.table("mark"), "mark", "left_semi").isEmpty():
                sums = self._wide_sums(wide(deployments))
                changed = sums.join(before, [*self.KEYS, "wide_n", "wide_hashes"], "left_anti").select(*self.KEYS)
                gone = before.join(sums, self.KEYS, "left_anti").select(*self.KEYS)
                # deployments can differ in a column that the wide rows of others make up for; their sums are noted anew
                changed = changed.unionByName(self._sums(deployments).join(before, [*self.KEYS, "n", "sum_of_hashes"], "left_anti").select(*self.KEYS)).distinct()
            else:
                below = deployments.join(F.broadcast(bound.select("chain_id", "bound")), "chain_id", "left").filter("bound is null or block_number <= bound").drop("bound")
                below = self._sums(below)
                same = below.join(before, [*self.KEYS, "n", "sum_of_hashes"], "left_anti").isEmpty() and before.join(below, self.KEYS, "left_anti").isEmpty()
                if same:
                    return 0
                sums = self._sums(deployments)
                changed = sums.join(before, [*self.KEYS, "n", "sum_of_hashes"], "left_anti").select(*self.KEYS)
                changed = changed.unionByName(self._relabelled(deployments, labels, spans, bound)).distinct()
                gone = before.join(sums, self.KEYS, "left_anti").select(*self.KEYS)
        new = self.next()
        changed = new.put("changed", changed)
        rows = self._bucketed(deployments).join(changed, self.KEYS, "left_semi").drop("block_bucket")
        written = new.put("rows", explorer.sorted_for_scans(wide(rows).drop("block_bucket"), self.width))
        noted = self._sums(rows).join(self._wide_sums(written), self.KEYS, "left")
        version = self.parts.replace(base, written.sortWithinPartitions(*self.KEYS, F.desc("block_number"), F.desc("create_index")), noted, gone)
        new.delete("rows")
        new.put("bounds", spans.select("chain_id", "first_block", F.col("last_block").alias("bound")))
        new.put("mark", mark)
        new.put("state", self.spark.createDataFrame([(version,)], "wide long"))
        count = changed.count()
        new.mark()
        return count

    def _relabelled(self, deployments: DataFrame, labels: DataFrame, spans: DataFrame, bound: DataFrame) -> DataFrame:
        """Buckets with an address whose label lies in the chain's span now and didn't before, or the other way round."""
        both = spans.join(bound.withColumnRenamed("first_block", "first_before"), "chain_id", "left")
        moved = labels.select("chain_id", "contract_address", F.col("block_number").alias("_b")).join(F.broadcast(both), "chain_id")
        moved = moved.filter("coalesce(_b between first_block and last_block, false) <> coalesce(_b between first_before and bound, false)")
        addresses = moved.select("chain_id", "contract_address").distinct()
        return self._bucketed(deployments.join(addresses, ["chain_id", "contract_address"], "left_semi")).select(*self.KEYS).distinct()

    def served(self, deployments: DataFrame, meta: DataFrame, loaded: bool = True) -> DataFrame:
        return explorer.served_view(self.table("wide"), self.table("bounds").select("chain_id", "bound"), deployments, meta, loaded)


class Registry(_Versions):
    """Labels of a chain, in parts by address, with the files and their lineage, in parts by file, that they were made from."""

    def __init__(self, spark: SparkSession, root: str, chain: int):
        super().__init__(spark, root)
        self.chain = chain
        self.labels, self.lineage = Parts(spark, f"{root}/labels", "label_part"), Parts(spark, f"{root}/lineage", "file_id")

    def _in_parts(self) -> dict[str, Parts]:
        return {"labels": self.labels, "lineage": self.lineage}

    def table(self, name: str) -> DataFrame:
        if name == "labels":
            return self.labels.rows(self._noted("labels")).drop("label_part")
        if name == "lineage":
            return self.lineage.rows(self._noted("lineage")).drop("file_id")
        return super().table(name)

    def refresh(self, listing: DataFrame, deployed: DataFrame, verified, as_of: int) -> str:
        """Bring the labels in line with the listed files: "imported", "updated", "repaired" or "unchanged".

        Only addresses that a changed, new or vanished verification file named before or
        names now are derived again; all are, at first or if a deployment file changed
        or the stored labels contradict the recorded count. verified is a table with a
        column file, or a function that reads those of some files (file) or, given None,
        of all: an update reads the changed files, and then those that name the same
        addresses, which the lineage tells.
        """
        read = verified if callable(verified) else lambda files: verified if files is None else verified.join(F.broadcast(files), "file", "left_semi")
        how, gone = "imported", None
        if self.current() is not None:
            manifest = self.table("manifest")
            gone = manifest.join(listing.select("path"), "path", "left_anti").filter("not is_deployment").select("path")
            changed = verification.changed_files(listing, manifest).unionByName(gone)
            whole = not listing.join(manifest, ["path", "length", "modified"], "left_anti").filter("is_deployment").isEmpty() or not manifest.join(listing.select("path"), "path", "left_anti").filter("is_deployment").isEmpty()
            if changed.isEmpty():
                if verification.consistent(self.table("labels"), self.table("imports")).filter("not consistent").isEmpty():
                    return "unchanged"
                how = "repaired"
            else:
                how = "imported" if whole else "updated"
        new = self.next()
        if how == "updated":
            versions = self._update(new, changed.select(F.col("path").alias("file")), gone.select(F.col("path").alias("file")), deployed, read, as_of)
        else:
            rows = verification.label_rows(verification.derive(deployed, read(None), self.chain), self.chain, as_of)
            versions = self._replace(None, None, rows, verification.lineage(deployed, read(None), self.chain), listing.filter("not is_deployment").select(F.col("path").alias("file")))
        labels = self.labels.rows(versions[0])
        new.put("manifest", listing)
        new.put("imports", labels.agg(F.count("*").alias("recorded")).select(F.lit(self.chain).cast("long").alias("chain_id"), "recorded"))
        new.put("state", self.spark.createDataFrame([versions], "labels long, lineage long"))
        new.mark()
        return "updated" if how == "imported" and gone is not None else how

    def _update(self, new: Tables, changed: DataFrame, gone: DataFrame, deployed: DataFrame, read, as_of: int) -> tuple[int, int]:
        of = self._noted("labels"), self._noted("lineage")
        now = new.put("lineage_now", verification.lineage(deployed, read(changed), self.chain))
        old = self.lineage.rows(of[1]).drop("file_id")
        touched = new.put("touched", verification.affected(old, now, changed.withColumnRenamed("file", "path")))
        rest = old.join(changed, "file", "left_anti").unionByName(now)
        files = new.put("files", rest.join(touched, "address", "left_semi").select("file").distinct())
        fresh = verification.label_rows(verification.recompute(deployed, read(files), self.chain, touched), self.chain, as_of)
        part = _label_part("address")
        parts = touched.select(part.alias("label_part")).distinct()
        kept = self.labels.rows(of[0]).join(parts, "label_part", "left_semi").drop("label_part")
        rows = verification.replaced(kept, touched, fresh, self.chain)
        still = changed.join(gone, "file", "left_anti")
        return self._replace(of[0], of[1], rows, now, still, parts, gone)

    def _replace(self, labels: int | None, lineage: int | None, rows: DataFrame, names: DataFrame, files: DataFrame, parts: DataFrame | None = None, gone: DataFrame | None = None) -> tuple[int, int]:
        if parts is None:
            parts = self.spark.range(LABEL_PARTS).select(F.col("id").cast("int").alias("label_part"))
        id_of = lambda df: df.withColumn("file_id", F.sha2("file", 256))
        placed = rows.withColumn("label_part", _label_part("contract_address")).repartition("label_part")
        return (
            self.labels.replace(labels, placed, parts),
            self.lineage.replace(lineage, id_of(names).repartition("file_id"), id_of(files).select("file_id").distinct(), None if gone is None else id_of(gone)),
        )


def _label_part(address: str):
    return F.pmod(F.xxhash64(address), F.lit(LABEL_PARTS)).cast("int")


class DecodedFiles:
    """Metadata by address from contract files, each file decoded once for its size and time.

    A run notes the files that it starts with, decodes the hashes that nobody has decoded
    yet, writes the rows of each file as a part, and notes the files as done with the
    manifest, last. So files that a run which died had begun are begun anew, and what it
    left counts for nothing; its hashes stay decoded.
    """

    FILE = "path string, length long, modificationTime timestamp"

    def __init__(self, spark: SparkSession, root: str, kind: str = "binary"):
        self.spark, self.kind = spark, kind
        self.files, self.hashes = Parts(spark, f"{root}/files", "file_id"), Segments(spark, f"{root}/hashes", "metadata")

    def done(self) -> DataFrame:
        """(path, length, modificationTime, rows) of the files that are decoded."""
        now = self.files.version()
        return self.spark.createDataFrame([], self.FILE + ", rows long") if now is None else self.files.manifest(now).drop("file_id", "in_version")

    def metadata(self) -> DataFrame:
        """By code hash."""
        return self.hashes.rows("metadata", schemas.metadata(self.kind), self.hashes.cover())

    def addresses(self) -> DataFrame:
        """By address and file of the files that are done."""
        return self.files.rows(self.files.version()).drop("file_id")

    def read_files(self, paths: list[str]) -> DataFrame:
        rows = self.spark.read.schema(schemas.CONTRACT_FILE).parquet(*paths)
        return rows.select("*", plain_path(F.col("_metadata.file_path")).alias("path"))

    def run(self, listing: DataFrame, as_of: str, files_a_run: int = 1000, read: Callable[[list[str]], DataFrame] | None = None, overwrite: bool = False) -> int:
        """Decode listed files (path, length, modificationTime) that aren't done with this size and time, so many at a time; returns how many.

        read gives the rows (chain_id, contract_address, code_hash, n_code_bytes, code,
        path) of some paths. overwrite decodes every listed file again. Files that aren't
        listed any more keep their rows.
        """
        listing = listing.select(plain_path(F.col("path")).alias("path"), "length", "modificationTime")
        count, skip = 0, None if overwrite else self.done()
        while True:
            due = listing if skip is None else decode.unfinished(listing, skip)
            due = due.orderBy("path").limit(files_a_run)
            base = self.files.version()
            number = (base or 0) + 1
            due = self.files.put(f"started/version={number}", due)
            paths = [r.path for r in due.select("path").collect()]  # at most files_a_run
            if not paths:
                return count
            rows = (read or self.read_files)(paths)
            known = self.hashes.rows("metadata", schemas.metadata(self.kind), [s for s in self.hashes.cover() if s.last != number])
            found = decode.decode_hashes(decode.eligible(rows), known, as_of)
            found = self.hashes.append("metadata", found, number).unionByName(known)
            decoded = self.files.put("work", decode.file_addresses(rows, found).withColumn("file_id", F.sha2("path", 256)).repartition("file_id", "contract_address"))
            sizes = decoded.groupBy("path").agg(F.count("*").alias("rows"))
            noted = due.join(sizes, "path", "left").withColumns({"rows": F.coalesce("rows", F.lit(0).cast("long")), "file_id": F.sha2("path", 256)})
            self.files.replace(base, decoded.repartitionByRange("file_id", "contract_address"), noted.select("file_id", "path", "length", "modificationTime", "rows"))
            self.files.delete("work")
            count += len(paths)
            if overwrite:
                skip = due if skip is None else skip.select(*due.columns).unionByName(due)
            else:
                skip = self.done()


def plain_path(path):
    """Local paths are written with one slash or three; both name the same file."""
    return F.regexp_replace(path, "^file:/+", "file:/")

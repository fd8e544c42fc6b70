"""Parquet tables that grow by batches or are replaced, on any file system that Spark reaches.

A replaced table is a folder of numbered versions; the highest one that was
committed (Spark writes _SUCCESS last) is current, so a swap is atomic and a reader
that has resolved a version keeps it. Segments are what batches wrote: small ones are
merged level by level and deleted once no reader needs them. Parts are replaced one by
one, each found in the version that wrote it last.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from time import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TOGETHER = 4  #: independent tables that are written at the same time
FANOUT = 10  #: segments of a level that are merged into one of the next
GRACE = 3600  #: seconds for which readers may still use what was merged or replaced


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster names for checkpoints and that all executors share.

    Where none is named, a local session, all of it one process, gets a temporary
    one; a cluster is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-tables-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def empty(spark: SparkSession, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


class Tables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, below: str = ""):
        """A path under the root, and its file system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}{below}")
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, pattern: str) -> list[tuple[str, float]]:
        """Names below a pattern's folder, with their times in seconds; one listing."""
        path, fs = self._path(f"/{pattern}")
        return [(status.getPath().getName(), status.getModificationTime() / 1000) for status in fs.globStatus(path) or []]

    def _marked(self, pattern: str) -> list[tuple[str, float]]:
        """Names of folders that were written to the end, and when; one listing."""
        path, fs = self._path(f"/{pattern}/_SUCCESS")
        return [(status.getPath().getParent().getName(), status.getModificationTime() / 1000) for status in fs.globStatus(path) or []]

    def delete(self, below: str) -> None:
        path, fs = self._path(f"/{below}")
        fs.delete(path, True)

    def committed(self, prefix: str) -> list[int]:
        """The numbers n of the folders prefix=n that were written to the end, ascending."""
        found = (name.partition("=")[2] for name, _ in self._marked(f"{prefix}=*"))
        return sorted(int(n) for n in found if n.isdigit())

    def _committed(self, name: str, kind: str) -> list[int]:
        return self.committed(f"{name}/{kind}")

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Write a table of this root, which counts once the root is marked."""
        return self._write(df, name, ())

    def mark(self) -> None:
        """Let the root itself count as committed."""
        path, fs = self._path("/_SUCCESS")
        fs.create(path).close()

    def _read(self, paths: list[str], schema) -> DataFrame:
        if not paths:
            return empty(self.spark, schema)
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*paths)

    def swap(self, name: str, df: DataFrame) -> DataFrame:
        """Make df the table's current version."""
        version = max(self._committed(name, "version"), default=0) + 1
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/version={version}")
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self._read([f"{self.root}/{name}/version={v}" for v in self._committed(name, "version")[-1:]], schema)

    def _write(self, df: DataFrame, below: str, partition_by) -> DataFrame:
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.root}/{below}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{below}")


def together(*jobs: Callable[[], object]) -> list:
    """Run independent jobs at the same time; the first failure is raised once all have ended."""
    with ThreadPoolExecutor(TOGETHER) as pool:
        waiting = [pool.submit(job) for job in jobs]
    return [w.result() for w in waiting]


@dataclass(frozen=True, order=True)
class Segment:
    """The batches first to last, as one folder of each table that they wrote."""

    first: int
    last: int
    level: int = 0

    @property
    def folder(self) -> str:
        return f"segment={self.first}-{self.last}.{self.level}"

    @classmethod
    def of(cls, folder: str) -> Segment:
        span, _, level = folder.partition("=")[2].partition(".")
        first, _, last = span.partition("-")
        return cls(int(first), int(last), int(level))


def segment_last():
    """The last batch of the segment that a row was read from."""
    return F.expr("cast(substring_index(substring_index(segment, '.', 1), '-', -1) as bigint)")


class Segments(Tables):
    """Tables to which batches append. A batch's table of marks is written last, and the batch counts once it is there.

    Ten segments of a level become one of the next, so a reader lists and opens a number
    of folders that grows with the logarithm of the batches, and a row is written again
    as often. Merged segments stay for readers that have listed them, until clean().
    """

    def __init__(self, spark: SparkSession, root: str, mark: str, fanout: int = FANOUT):
        super().__init__(spark, root)
        self.mark_table, self.fanout = mark, fanout

    def all(self) -> list[Segment]:
        return sorted(Segment.of(name) for name, _ in self._marked(f"{self.mark_table}/segment=*"))

    def cover(self) -> list[Segment]:
        """The segments that stand for all batches, ascending: a merged one instead of those in it."""
        upto, out = -1, []
        for s in sorted(self.all(), key=lambda s: (s.first, -s.last, -s.level)):
            if s.first > upto:
                out.append(s)
                upto = s.last
        return out

    def has(self, number: int) -> bool:
        return any(s.first <= number <= s.last for s in self.cover())

    def present(self, name: str, segments: list[Segment]) -> list[Segment]:
        """Those of some segments that have the table."""
        found = {x for x, _ in self._names(f"{name}/segment=*")}
        return [s for s in segments if s.folder in found]

    def rows(self, name: str, schema: str, segments: list[Segment]) -> DataFrame:
        """A table's rows in some segments; segment is a column that a schema may ask for."""
        nothing, there = empty(self.spark, schema), self.present(name, segments)
        if not there:
            return nothing
        paths = [f"{self.root}/{name}/{s.folder}" for s in there]
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*paths).select(*nothing.columns)

    def append(self, name: str, df: DataFrame, number: int, *partition_by: str) -> DataFrame:
        """Write a batch's rows of a table, anew if they are there, and read them back."""
        return self.write(name, df, Segment(number, number), *partition_by)

    def write(self, name: str, df: DataFrame, segment: Segment, *partition_by: str) -> DataFrame:
        return self._write(df, f"{name}/{segment.folder}", partition_by)

    def due(self) -> list[Segment]:
        """The last segments of a level, if there are as many as make one of the next."""
        run: list[Segment] = []
        for s in reversed(self.cover()):
            if run and s.level > run[-1].level:
                if len(run) >= self.fanout:
                    break
                run = []
            run.insert(0, s)
        return run if len(run) >= self.fanout and len({s.level for s in run}) == 1 else []

    def clean(self, grace: float = GRACE) -> int:
        """Delete segments that a merged one has replaced for grace seconds; returns how many."""
        marked = [(Segment.of(name), at) for name, at in self._marked(f"{self.mark_table}/segment=*")]
        inside = lambda s, by: s != by and by.first <= s.first and s.last <= by.last and s.level < by.level
        old = [s for s, _ in marked if any(inside(s, by) and at <= time() - grace for by, at in marked)]
        for s in old:
            self.delete(f"{self.mark_table}/{s.folder}")  # from here on nobody lists it
        names = [x for x, _ in self._names("*")] if old else []
        for name in names:
            for s in self.present(name, old):
                self.delete(f"{name}/{s.folder}")
        return len(old)


class Parts(Tables):
    """A table whose parts, given by the values of some key columns, are replaced one by one.

    rows/version=N holds the parts that version N wrote, and manifest/version=N, written
    last, says of every part in which version its rows are (and what else is to be known
    about it). So a change costs the parts that it changes, a version that died before
    its manifest is nothing, and a reader keeps the manifest that it has resolved.
    """

    MOST = 20  #: versions in use, beyond which the next replacement writes all parts anew

    def __init__(self, spark: SparkSession, root: str, *keys: str, folders: list[str] | None = None):
        """folders are the columns whose values have folders of their own, by default the keys; few of them where parts are many, since each costs a file."""
        super().__init__(spark, root)
        self.keys, self.folders = [*keys], [*keys] if folders is None else folders

    def version(self) -> int | None:
        found = self.committed("manifest/version")
        return found[-1] if found else None

    def manifest(self, version: int) -> DataFrame:
        """The keys of every part, what was noted about it, and in_version."""
        return self.spark.read.parquet(f"{self.root}/manifest/version={version}")

    def rows(self, version: int) -> DataFrame:
        """All rows as of a version."""
        manifest = self.manifest(version).select(*self.keys, "in_version")
        used = [r.in_version for r in manifest.select("in_version").distinct().collect()]  # at most MOST and one
        there = [v for v in used if self._names(f"rows/in_version={v}")]
        schema = self.spark.read.parquet(f"{self.root}/columns/version={version}").schema
        if not there:
            return empty(self.spark, schema)
        reader = self.spark.read.schema(StructType([*schema.fields]).add("in_version", "long")).option("basePath", f"{self.root}/rows")
        found = reader.parquet(*(f"{self.root}/rows/in_version={v}" for v in there))
        return found.join(manifest, [*self.keys, "in_version"], "left_semi").select(*schema.names)

    def replace(self, base: int | None, rows: DataFrame, parts: DataFrame, gone: DataFrame | None = None) -> int:
        """A new version: some parts (their keys and what is noted about them) have these rows now, those in gone none, and all others what they had in version base.

        Rows are dealt as they come. Returns the version's number.
        """
        new = max([0, *self.committed("manifest/version")]) + 1
        noted = parts.withColumn("in_version", F.lit(new).cast("long"))
        if base is not None:
            before = self.manifest(base)
            kept = before.join(parts.select(*self.keys), self.keys, "left_anti")
            if gone is not None:
                kept = kept.join(gone.select(*self.keys), self.keys, "left_anti")
            if before.select("in_version").distinct().count() > self.MOST:
                rows = rows.unionByName(self.rows(base).join(kept.select(*self.keys), self.keys, "left_semi"))
                kept = kept.withColumn("in_version", F.lit(new).cast("long"))
            noted = noted.select(*before.columns).unionByName(kept)
        self._write(rows, f"rows/in_version={new}", self.folders)
        self._write(empty(self.spark, rows.schema), f"columns/version={new}", ())
        self._write(noted, f"manifest/version={new}", ())
        return new

    def clean(self, keep: int, grace: float = GRACE) -> None:
        """Delete what only versions before keep used, once keep is older than grace seconds."""
        marked = {int(name.partition("=")[2]): at for name, at in self._marked("manifest/version=*")}
        if keep not in marked or marked[keep] > time() - grace:
            return
        used = {r.in_version for r in self.manifest(keep).select("in_version").distinct().collect()}
        for v in [v for v in marked if v < keep]:
            self.delete(f"manifest/version={v}")
            self.delete(f"columns/version={v}")
        for name, _ in self._names("rows/in_version=*"):
            v = int(name.partition("=")[2])
            if v < keep and v not in used:
                self.delete(f"rows/{name}")


def checksum(*columns: str) -> list:
    """Aggregates n and sum_of_hashes over some columns: equal for equal rows in any order."""
    return [F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("sum_of_hashes")]

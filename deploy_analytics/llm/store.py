"""Tables in the folder that every executor shares, and the setting of Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors share.

    Where none is named, a local session, all of it one process, gets a temporary
    one; a cluster is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here.

    Later stages read files, so a lost executor costs its running tasks only, and
    columns made by nondeterministic expressions (row ids) are fixed from here on.
    """
    return _stored(df, name)


def materialize_texts(df: DataFrame, name: str) -> DataFrame:
    """materialize() for a table that holds the whole input's texts once more: compressed more."""
    return _stored(df, name, compression="zstd")


def _stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by materialize() that no later stage reads."""
    for df in tables:
        session = df.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def maybe_in(rows: DataFrame, needed: DataFrame, key: str, words: int) -> DataFrame:
    """The rows whose key is in needed, and a few others: those whose bit in a broadcast bitmap of words of 64 bits is set.

    One that is full lets all rows pass. An exact join may follow, which then shuffles few rows.
    """
    hashed = F.xxhash64(key)
    word, bit = F.pmod(F.shiftright(hashed, 6), F.lit(words)), hashed.bitwiseAND(F.lit(63)).cast("int")
    bits = needed.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    met = rows.withColumns({"word": word, "bit": bit}).join(F.broadcast(bits), "word")
    return met.filter("shiftright(bits, bit) & 1 = 1").select(*rows.columns)


def python_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def whole_text(df: DataFrame, text: str = "text"):
    """The text column; null counts as empty."""
    return F.coalesce(df[text].cast("string"), F.lit(""))

"""Exact dedup by deterministic block naming (operator 10, DataFrame functions only).

Every text, lower-cased in A-Z, is cut into blocks of a fixed number of code
points. The distinct blocks are sorted and numbered: a block's number is its name,
so equal blocks and only they share one. Then adjacent names are paired, distinct
pairs are sorted and numbered in turn, and so on until a document has one name.
Two documents have equal (level, name) exactly when their texts are equal: no
fingerprint takes part in the decision.

Blocks reach their names over a 128-bit key instead of the text, so that a text is
shuffled once. The naming groups by key *and* text, and the keys are used only
after a count has shown that no two different blocks share one; otherwise the
naming is done again with other seeds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NONE = -1  #: the right half of a pair whose left half is a document's last


def _blocks(text, size: int):
    """The text in blocks of size code points; an empty text is one empty block."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}|^$"), F.lit(0))


def _numbered(distinct: DataFrame, *keys: str) -> DataFrame:
    """Names for distinct rows: sorted in each partition and numbered, unique over all."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _keys(seed: int):
    return F.xxhash64(F.lit(seed), "block").alias("h1"), F.xxhash64("block", F.lit(~seed)).alias("h2")


def block_names(docs: DataFrame, text: str, block_chars: int) -> tuple[DataFrame, int]:
    """(h1, h2, name) of every distinct block, and the seed under which no two share a key."""
    normal = F.translate(store.whole_text(docs, text), UPPER, LOWER)
    blocks = docs.select(F.explode(_blocks(normal, block_chars)).alias("block"))
    seed = 0
    while True:
        keyed = blocks.select(*_keys(seed), "block").distinct()
        names = store.materialize(_numbered(keyed, "h1", "h2", "block").select("h1", "h2", "name"), "block-names")
        if names.groupBy("h1", "h2").count().filter("count > 1").isEmpty():
            return names, seed
        store.discard(names)
        seed += 1


def identities(docs: DataFrame, text: str = "text", key: str = "doc_id", block_chars: int = 1024) -> DataFrame:
    """One row per row of docs: rid, key, text_sha256, level, name; (level, name) is the text's identity.

    Null texts count as empty, and an empty text is one empty block. Rows are told
    apart by rid, so null or repeated keys do no harm; columns besides key and text
    are not read. Groups of any size only meet in partial aggregates and in joins
    that Spark may split.
    """
    names, seed = block_names(docs, text, block_chars)
    normal = F.translate(store.whole_text(docs, text), UPPER, LOWER)
    cells = (
        docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"), normal.alias("text"))
        .select("rid", "key", F.sha2("text", 256).alias("sha"), _blocks(F.col("text"), block_chars).alias("blocks"))
        .select("rid", "key", "sha", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block"))
        .select("rid", F.when(F.col("pos") == 0, F.col("key")).alias("key"), F.when(F.col("pos") == 0, F.col("sha")).alias("sha"), "n", "pos", *_keys(seed))
    )
    cells = store.materialize(cells, "block-cells")
    rows = cells.filter("pos = 0").select("rid", "key", F.col("sha").alias("text_sha256"))
    named = store.materialize(cells.join(names, ["h1", "h2"]).select("rid", "pos", "n", "name"), "named-0")
    store.discard(names)
    roots = named.filter("n = 1").select("rid", F.lit(0).alias("level"), "name")
    level, most = 0, named.agg(F.max("n")).first()[0] or 1
    while most > 1:
        level, most = level + 1, (most + 1) // 2
        pairs = (
            named.filter("n > 1")
            .groupBy("rid", F.expr("pos div 2").cast("int").alias("pos"), F.expr("(n + 1) div 2").cast("int").alias("n"))
            .agg(F.max(F.expr("if(pos % 2 = 0, name, null)")).alias("a"), F.coalesce(F.max(F.expr("if(pos % 2 = 1, name, null)")), F.lit(NONE)).alias("b"))
        )
        pair_names = store.materialize(_numbered(pairs.select("a", "b").distinct(), "a", "b"), "pair-names")
        named = store.materialize(pairs.join(pair_names, ["a", "b"]).select("rid", "pos", "n", "name"), f"named-{level}")
        store.discard(pair_names)
        roots = roots.unionByName(named.filter("n = 1").select("rid", F.lit(level).alias("level"), "name"))
    return rows.join(roots, "rid")


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", block_chars: int = 1024) -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest key stays (null is the least; of rows
    that share the largest key too, one stays). An empty table gives an empty result.
    """
    rows = store.materialize(identities(docs, text, key, block_chars), "identities")
    groups = rows.groupBy("level", "name").agg(F.max(F.struct("key", "rid")).alias("best"), F.count("*").alias("group_size"))
    groups = store.materialize(groups.filter("group_size > 1"), "copy-groups")
    return rows.join(groups, ["level", "name"], "left").select(
        F.col("key").alias(key),
        F.when(F.col("best").isNull(), F.col("key")).otherwise(F.col("best.key")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("best").isNull() | (F.col("best.rid") == F.col("rid"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns, whatever their names.

    Of rows with equal text and key, nulls included, one stays.
    """
    kept = exact_dedup(docs, text, key).filter("kept").select(F.col(key).alias("kept_key"), F.col("text_sha256").alias("kept_sha"))
    sha = F.sha2(F.translate(store.whole_text(docs, text), UPPER, LOWER), 256)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("k"), sha.alias("sha"))
    met = rows.join(kept, F.col("k").eqNullSafe(F.col("kept_key")) & (F.col("sha") == F.col("kept_sha")), "left_semi")
    return met.dropDuplicates(["k", "sha"]).select("row.*")


def op10_exact_dedup(spark, sf_dir):
    docs = store.documents(spark, sf_dir, "doc_id", "text")
    return exact_dedup(docs)


ORACLE = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""

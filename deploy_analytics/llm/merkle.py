"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences (operator 4, DataFrame functions only).

A section is up to eight lines, ending early at an empty line; a paragraph is a
line; its leaves are sentences, cut after 200 code points if they are longer. The
parts of a level join up to the text. Each node is the SHA-256 of its children's
digests, so equal roots mean equal texts. A fingerprint is a string:

    root|section:leaf,leaf,...|section:...

with 16 hex digits for a section, and 16 with the length in code points for a leaf.
Two fingerprints are compared from the top: equal roots end it, equal sections are
skipped, and the leaves of the others show what differs.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store

SECTION = r"(?:[^\n]+(?:\n|\z)){1,8}\n*|\n+"
PARAGRAPH = r"[^\n]*\n+|[^\n]+"
SUBRANGE_BITS = 6
SUBRANGES = 1 << SUBRANGE_BITS  #: ranges of a key that many rows share
LEAF = r"[^\n.!?]{1,200}[\n.!?]*|[\n.!?]{1,200}"


def _parts(text, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _digest(kind: str, children: Column) -> Column:
    return F.sha2(F.concat(F.lit(kind), F.array_join(children, "")), 256)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the fingerprint of a text column; null texts count as empty. The empty text has a root and no sections."""
    leaf = lambda x: F.struct(F.sha2(F.concat(F.lit("leaf"), x), 256).alias("h"), F.char_length(x).alias("n"))
    tree = F.transform(_parts(store.whole_text(df, text), SECTION), lambda s: F.transform(_parts(s, PARAGRAPH), lambda p: F.transform(_parts(p, LEAF), leaf)))
    paragraph = lambda leaves: _digest("paragraph", F.transform(leaves, lambda x: x["h"]))
    short = lambda x: F.concat(F.substring(x["h"], 1, 16), x["n"].cast("string"))
    section = lambda s: F.struct(_digest("section", F.transform(s, paragraph)).alias("h"), F.array_join(F.transform(F.flatten(s), short), ",").alias("leaves"))
    root = _digest("root", F.transform("_sections", lambda s: s["h"]))
    line = lambda s: F.concat(F.lit("|"), F.substring(s["h"], 1, 16), F.lit(":"), s["leaves"])
    out = df.withColumn("_tree", tree).withColumn("_sections", F.transform("_tree", section))
    return out.withColumn(name, F.concat(root, F.array_join(F.transform("_sections", line), ""))).drop("_tree", "_sections")


def _sections(fingerprint: Column) -> Column:
    parts = F.split(fingerprint, "[|]")
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def _leaves(sections: Column) -> Column:
    return F.flatten(F.transform(sections, lambda s: F.split(F.substring_index(s, ":", -1), ",")))


def _weight(leaves: Column) -> Column:
    return F.aggregate(leaves, F.lit(0).cast("long"), lambda total, x: total + F.substring(x, 17, 20).cast("long"))


def with_likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """df with the likeness of two fingerprints: twice the common code points over all, by distinct leaves, 0 to 1."""
    one, two = _sections(F.col(a)), _sections(F.col(b))
    out = df.withColumns({
        "_same": F.array_intersect(one, two),
        "_one": F.array_distinct(_leaves(F.array_except(one, two))),
        "_two": F.array_distinct(_leaves(F.array_except(two, one))),
    })
    same, both = 2 * _weight(_leaves(F.col("_same"))), _weight(F.col("_one")) + _weight(F.col("_two"))
    out = out.withColumns({"_same": same, "_both": both, "_met": 2 * _weight(F.array_intersect("_one", "_two"))})
    share = (F.col("_same") + F.col("_met")) / F.greatest(F.col("_same") + F.col("_both"), F.lit(1))
    equal = F.substring(a, 1, 64) == F.substring(b, 1, 64)
    return out.withColumn(name, F.when(equal, 1.0).otherwise(share)).drop("_same", "_one", "_two", "_both", "_met")


def locate_edits(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, start, length) of each leaf of fingerprint a that b lacks: where a's text differs, in code points."""
    leaves = df.select(key, F.col(b).alias("_b"), F.posexplode(_leaves(_sections(F.col(a)))).alias("_at", "_leaf"))
    length = F.substring("_leaf", 17, 20).cast("long")
    end = F.sum(length).over(Window.partitionBy(key).orderBy("_at"))
    return leaves.select(key, "_b", "_leaf", (end - length).alias("start"), length.alias("length")).filter(~F.expr("contains(_b, _leaf)")).select(key, "start", "length")


def by_ranges(docs: DataFrame, key: str, tie: str):
    """docs dealt by ranges of an ascending key, and the window in which the next row is lead().

    Nulls come last, equal keys by a hash of the column tie, then by it; after the last
    row comes the first. There are four times as many ranges as shuffle partitions, and
    their bounds are all that the driver sees. A key that fills a range by itself, and
    null, are dealt over SUBRANGES ranges by that hash. Each range also gets the first row
    of the next one; such copies are marked in _copy and are to be dropped after lead().
    """
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = docs.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 100_000).alias("bounds"), F.count_if(F.col(key).isNull()).alias("nulls")).first()
    bounds = sorted(set(found.bounds or []))
    hot = [v for v, n in Counter(found.bounds or []).items() if n > 1]
    docs = docs.withColumn("_tie", F.xxhash64(tie) if hot or found.nulls > 1 else F.lit(0).cast("long"))
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x < F.col(key))) if bounds else F.lit(0)
    part = F.shiftright("_tie", 64 - SUBRANGE_BITS).cast("int") + SUBRANGES // 2 + 1  # from 1, in the order of the hash
    place = F.when(F.col(key).isNull(), len(bounds) + 1).otherwise(at) * (SUBRANGES + 1) + F.when(F.col(key).isNull() | F.col(key).isin(hot), part).otherwise(0)
    docs = docs.withColumn("_range", place)
    # one row for each range
    firsts = docs.groupBy("_range").agg(F.min(F.struct(F.col(key).isNull(), key, "_tie")).alias("first")).select("_range", f"first.{key}", "first._tie")
    firsts = sorted((tuple(r) for r in firsts.collect()), key=lambda r: r[0])
    before = [(first, tie_, firsts[i - 1][0]) for i, (_, first, tie_) in enumerate(firsts)]
    table = spark.createDataFrame(before, f"_first {docs.schema[key].dataType.simpleString()}, _first_tie long, _before int")
    met = docs.join(F.broadcast(table), F.col(key).eqNullSafe(F.col("_first")) & (F.col("_tie") == F.col("_first_tie")), "left")
    own, copy = F.struct(F.col("_range").alias("r"), F.lit(False).alias("c")), F.struct(F.col("_before").alias("r"), F.lit(True).alias("c"))
    copies = F.explode(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, copy)))
    columns = [c for c in docs.columns if c != "_range"]
    rows = met.select(*columns, copies.alias("_to")).select(*columns, F.col("_to.r").alias("_range"), F.col("_to.c").alias("_copy"))
    return rows.repartition("_range"), Window.partitionBy("_range").orderBy("_copy", F.asc_nulls_last(key), "_tie", tie)


def fingerprints_with_edit(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: key (a number), n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text keeps the first half (rounded up) of the code points and goes on
    with as many as were cut off from the start of the next document, or all it has.
    Null texts count as empty. Other columns are not read. A single row is its own next.
    """
    docs = docs.select(F.col(key).alias("key"), store.whole_text(docs, text).alias("text"))
    rows, order = by_ranges(docs, "key", "text")
    rows = with_fingerprint(rows, "text", "fingerprint")
    rows = rows.withColumns({"next": F.lead("text").over(order), "next_fingerprint": F.lead("fingerprint").over(order)}).filter("not _copy")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.expr("concat(substring(text, 1, int(n_chars - n_chars div 2)), substring(next, 1, int(n_chars div 2)))")
    rows = rows.withColumn("edited", edited).drop("text", "next")
    rows = with_fingerprint(rows, "edited", "edited_fingerprint").withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    rows = with_likeness(rows, "fingerprint", "edited_fingerprint", "near_edited")
    rows = with_likeness(rows, "fingerprint", "next_fingerprint", "near_next")
    return rows.select(F.col("key").alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op4_fingerprints(spark, sf_dir):
    return fingerprints_with_edit(store.documents(spark, sf_dir, "doc_id", "text"))

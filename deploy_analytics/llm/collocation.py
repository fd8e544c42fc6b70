"""Phrase collocation mining over depth-truncated suffix subtrees (operator 13).

The suffixes of all pieces, cut off after a phrase's greatest length, are partitioned
vertically by the words that they begin with. A prefix that occurs less often than a
candidate must roots no subtree, so the partitioning first counts words, then pairs of
neighbouring frequent words, then triples of frequent pairs, and a suffix ends before its
first rare triple: none of what is cut off can be a candidate or a part of one. Prefixes start with two words; one with
more distinct suffixes than the memory budget is extended by a word. Each task then
takes whole prefixes, groups them up to the budget, and builds the subtrees of a group
by themselves: the group's suffixes are the leaves, with the number of their
occurrences, and a node's count is the total of the leaves below it.

What travels to the tasks has a fixed size: bitmaps of 2 ** 26 bits of hashed words, pairs
and triples, which may let a rare one pass and never lose a frequent one. Counts are made
from the words themselves.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store

#: What ends a piece, and what parts words, all of them single bytes in UTF-8.
PIECE_ENDS, WORD_ENDS = b".,;:!?\n\x0b\x0c\r", b" \t"
END = b"."  #: stands for every end of a piece in a list of words
NORMAL = bytes.maketrans(PIECE_ENDS + WORD_ENDS, END * len(PIECE_ENDS) + b" " * len(WORD_ENDS)).lower()  # of a table of all bytes, lower() is that of A-Z

CHUNK = 4 << 20  #: bytes of text whose words are handled together
DISTINCT = 400_000  #: words or suffixes that a task counts before it hands the counts on
PHRASES = 4_000_000  #: pairs or triples that a task counts before it hands the counts on
ROWS = 500  #: texts that are taken out of a batch together
MEMO = 400_000  #: words whose hashes a task remembers
BITS = 1 << 26  #: of a bitmap
BUDGET = 4096  #: leaves of a prefix, and of a group of prefixes to which one more is added
MOST_HEAVY = 1 << 16  #: prefixes of a level that may exceed the budget; with more leaves the budget grows


def _parts(data: bytes) -> Iterator[bytes]:
    """A normalised text in parts of some CHUNK, cut between pieces."""
    at = 0
    while len(data) - at > CHUNK and (end := data.find(END, at + CHUNK)) >= 0:
        yield data[at:end]
        at = end + 1
    yield data[at:]


def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, words) of rows (lang, text): words in order, with END between pieces and at the end."""
    held: dict[str, list[bytes]] = defaultdict(list)
    size = 0

    def words() -> Iterator[tuple[str, list[bytes]]]:
        for lang, parts in held.items():
            yield lang, END.join([*parts, b""]).replace(END, b" . ").split()
        held.clear()

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            few = batch.slice(at, ROWS)
            for lang, text in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), strict=True):
                for part in _parts(text.encode().translate(NORMAL)):
                    held[lang].append(part)
                    size += len(part)
                    if size >= CHUNK:
                        yield from words()
                        size = 0
    yield from words()


def _counted(langs: list[str], texts: list[bytes], counts: list[int], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names)


def _emptied(counts: dict[str, Counter], names: list[str], with_total: bool = False) -> Iterator[pa.RecordBatch]:
    """The counts by lang as rows; with_total adds each lang's sum under an empty text."""
    for lang, own in counts.items():
        if with_total:
            own[b""] = own.total()
        yield _counted([lang] * len(own), list(own), list(own.values()), names)
    counts.clear()


def count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = defaultdict(Counter)
    for lang, words in chunks(batches):
        counts[lang].update(words)
        del counts[lang][END]
        if sum(map(len, counts.values())) > DISTINCT:
            yield from _emptied(counts, ["lang", "phrase", "f"], True)
    yield from _emptied(counts, ["lang", "phrase", "f"], True)


# -- hashes and bitmaps


def word_hash(lang: str) -> Callable[[bytes], int]:
    """A function from a word to 64 bits that are never all zero."""
    import xxhash

    seed, digest = zlib.crc32(lang.encode()), xxhash.xxh64_intdigest
    return lambda word: digest(word, seed) or 1


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h) of rows (lang, word)."""
    by_lang: dict = {}
    for batch in batches:
        out = []
        for lang, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if lang not in by_lang:
                by_lang[lang] = word_hash(lang)
            out.append(by_lang[lang](word.encode()))
        yield pa.RecordBatch.from_arrays([pa.array(np.array(out, np.uint64).view(np.int64))], ["h"])


def bitmap(hashes: DataFrame) -> bytes:
    """The bits of all rows' h: made on Spark in segments of 4 KiB, of which there are BITS / 2 ** 15."""
    at = (F.col("h").bitwiseAND(F.lit(BITS - 1)) + 1).alias("at")
    segments = hashes.select(at).groupBy(F.bitmap_bucket_number("at").alias("segment")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = bytearray(BITS // 8)
    for r in segments.collect():
        out[(r.segment - 1) * 4096 : r.segment * 4096] = r.bits
    return bytes(out)


class Frequent(dict):
    """word -> its hash, or 0 if a bitmap rules out that it is frequent."""

    def __init__(self, lang: str, bits: bytes):
        super().__init__({END: 0})
        self.hash, self.bits = word_hash(lang), bits

    def __missing__(self, word: bytes) -> int:
        h = self.hash(word)
        at = h & (BITS - 1)
        found = self[word] = h if self.bits[at >> 3] >> (at & 7) & 1 else 0
        return found


def _words(batches: Iterable[pa.RecordBatch], bits: bytes) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """lang, words and their hashes, 0 for rare words and between pieces."""
    memos: dict[str, Frequent] = {}
    for lang, words in chunks(batches):
        if sum(map(len, memos.values())) > MEMO:
            memos.clear()
        memo = memos.setdefault(lang, Frequent(lang, bits))
        yield lang, words, np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def _levels(h: np.ndarray, maps: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each map, by position, whether the phrase of 2, 3, ... words from there on is frequent; and the hashes of phrases one word longer whose parts are."""
    key, ok, levels = h, h != 0, []
    for bits in [*maps, None]:
        may = ok[:-1] & ok[1:]
        key = pair_hashes(key[:-1], h[len(levels) + 1 :])
        if bits is None:
            return levels, key[may]
        at = key & np.uint64(BITS - 1)
        ok = may & (np.frombuffer(bits, np.uint8)[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        levels.append(ok)


def prefix_counter(word_bits, maps: list):
    """(h, n) of phrases whose parts, one word shorter, are frequent by the maps: of pairs without any, of triples with that of pairs, ..."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            h = np.concatenate([np.zeros(0, np.uint64), *held])
            held.clear()
            h.sort()
            at = np.flatnonzero(np.concatenate([np.ones(min(len(h), 1), bool), h[1:] != h[:-1]]))
            return pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(np.diff([*at, len(h)]) if len(at) else at)], ["h", "n"])

        for _, _, h in _words(batches, word_bits.value):
            held.append(_levels(h, [m.value for m in maps])[1])
            size += len(held[-1])
            if size >= PHRASES:
                yield counted()
                size = 0
        yield counted()

    return count


def suffix_counter(word_bits, maps: list, longest: int):
    """(lang, phrase, n): suffixes of at least two words, cut off after longest words and before the first rare prefix of a part."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        for lang, words, h in _words(batches, word_bits.value):
            levels = [np.concatenate([ok, np.zeros(len(h) + longest - len(ok), bool)]) for ok in _levels(h, [m.value for m in maps])[0]]
            run, more = np.zeros(len(h), np.int64), np.ones(len(h), bool)
            for k in range(longest - 1):
                last = min(k, len(levels) - 1)
                more &= levels[last][k - last : k - last + len(h)]
                run += more
            starts = np.flatnonzero(run)
            counts[lang].update(b" ".join(words[i:j]) for i, j in zip(starts.tolist(), (starts + run[starts] + 1).tolist(), strict=True))
            if sum(map(len, counts.values())) > DISTINCT:
                yield from _emptied(counts, ["lang", "phrase", "n"])
        yield from _emptied(counts, ["lang", "phrase", "n"])

    return count


# -- vertical partitioning and subtrees


def with_prefixes(leaves: DataFrame, longest: int, budget: int) -> DataFrame:
    """leaves with depth and prefix, the first depth words: as few, from two on, as leave a prefix at most budget leaves.

    A prefix of all the words of the longest phrases has one leaf, so there it ends. At
    most one prefix in budget leaves is extended; the budget grows with the leaves, so
    that no level extends more than MOST_HEAVY, and 64-bit keys of those are broadcast.
    """
    budget = max(budget, leaves.count() // MOST_HEAVY)
    out = leaves.withColumn("depth", F.lit(2))
    for depth in range(2, longest):
        key = F.xxhash64("lang", F.substring_index("phrase", " ", depth))
        heavy = out.filter(F.col("depth") == depth).groupBy(key.alias("heavy")).count().filter(F.col("count") > budget).select("heavy")
        out = out.join(F.broadcast(heavy), key == F.col("heavy"), "left")
        out = out.withColumn("depth", F.when(F.col("heavy").isNotNull(), depth + 1).otherwise(F.col("depth"))).drop("heavy")
    return out.withColumn("prefix", F.expr("substring_index(phrase, ' ', depth)"))


def subtree(leaves: list[tuple[list[str], int]]) -> Iterator[tuple[list[str], int]]:
    """(words, count) of every node over some sorted leaves; a node closes once a leaf has left it."""
    path: list[str] = []
    totals: list[int] = []
    for words, n in [*leaves, ([], 0)]:
        same = 0
        while same < min(len(path), len(words)) and path[same] == words[same]:
            same += 1
        while len(totals) > same:
            total = totals.pop()
            yield path[: len(totals) + 1], total
            if totals:
                totals[-1] += total
        totals += [0] * (len(words) - same)
        if totals:
            totals[-1] += n
        path = words


def tree_builder(least: int, budget: int):
    """(lang, phrase, f, whole) of nodes of two words or more, from leaves sorted by lang and prefix.

    Nodes above their prefix are not whole: other prefixes, in other tasks, have leaves
    below them too.
    """

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[list[str], int]] = []
        depths: dict[str, int] = {}
        last: tuple = ()

        def nodes() -> pa.RecordBatch:
            found = [(" ".join(w), f, len(w) >= depths[" ".join(w[:2])]) for w, f in subtree(sorted(group)) if len(w) > 1]
            found = [x for x in found if x[1] >= least or not x[2]]
            columns = [pa.array([last[0]] * len(found), pa.string())]
            columns += [pa.array([x[i] for x in found], kind) for i, kind in ((0, pa.string()), (1, pa.int64()), (2, pa.bool_()))]
            return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "f", "whole"])

        for batch in batches:
            for lang, phrase, n, depth, prefix in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last and (lang, prefix) != last and (len(group) >= budget or lang != last[0]):
                    yield nodes()
                    group.clear()
                    depths.clear()
                last = lang, prefix
                words = phrase.split(" ")
                group.append((words, n))
                root = " ".join(words[:2])
                depths[root] = max(depth, depths.get(root, 0))
        if group:
            yield nodes()

    return build


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, budget: int = BUDGET, levels: int = 3) -> DataFrame:
    """(lang, phrase, f) of all phrases of 1 to longest words that occur at least ``least`` times, and of every lang's words together, under the empty phrase."""
    spark = docs.sparkSession
    store.python_workers(spark)
    rows = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), store.whole_text(docs, text).alias("text"))
    words = rows.mapInArrow(count_words, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    words = store.materialize(words.filter(f"f >= {int(least)} or phrase = ''"), "words")
    known = words.filter("phrase <> ''").select("lang", "phrase")
    word_bits = spark.sparkContext.broadcast(bitmap(known.mapInArrow(hashed, "h long")))
    maps: list = []
    for _ in range(2, min(levels, longest) + 1):
        prefixes = rows.mapInArrow(prefix_counter(word_bits, [*maps]), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
        maps.append(spark.sparkContext.broadcast(bitmap(prefixes.filter(F.col("n") >= least).select("h"))))
    leaves = rows.mapInArrow(suffix_counter(word_bits, maps, longest), "lang string, phrase string, n long")
    leaves = store.materialize(leaves.groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "suffixes")
    for bits in (word_bits, *maps):
        bits.destroy()
    dealt = with_prefixes(leaves, longest, budget).repartition("lang", "prefix").sortWithinPartitions("lang", "prefix")
    nodes = dealt.select("lang", "phrase", "n", "depth", "prefix").mapInArrow(tree_builder(least, budget), "lang string, phrase string, f long, whole boolean")
    nodes = store.materialize(nodes, "nodes")
    store.discard(leaves)
    split = nodes.filter("not whole").groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return words.unionByName(nodes.filter("whole").drop("whole")).unionByName(split)


# -- scores


def _inside(phrase: str = "phrase"):
    """All phrases of two words or more that lie contiguously inside one, itself excepted."""
    spans = lambda w: F.flatten(F.transform(F.sequence(F.lit(2), F.size(w) - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))))
    return F.transform(F.array(F.split(phrase, " ")), spans)[0]


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, top: int = 2000, share: int = 100, budget: int = BUDGET) -> DataFrame:
    """Each lang's best phrases: lang, rank, phrase, a, l, r, n, score.

    n counts a lang's words, a a phrase of 2 to longest words that occurs at least
    ``least`` times, l and r the parts of its cut with the lowest score
    floor(1000 * a * n / (l * r)), ties to the shortest first part. A phrase inside a
    longer one that has at least share hundredths of its occurrences is dropped. Order:
    score and a descending, then the phrase by bytes.

    Null texts count as empty, a null lang is ``und``, and rows count as often as they
    are there; other columns aren't read. An empty table gives no rows. All counts are
    whole and all arithmetic is exact (decimals of 38 digits).
    """
    counts = store.materialize(phrase_counts(docs, text, lang, least, longest, budget), "phrases")
    totals = counts.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    known = counts.filter("phrase <> ''")
    phrases = known.withColumn("words", F.size(F.split("phrase", " "))).filter("words > 1")
    cuts = phrases.join(totals, "lang").select("lang", "phrase", F.col("f").alias("a"), "n", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - words)")})
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("over", (exact("a") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(19,0)") * exact("n")).withColumn("under", exact("l") * exact("r"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(F.expr("over div under").alias("score"), "k", "l", "r", "a", "n")).alias("b"))
    inside = phrases.filter("words > 2").select("lang", F.col("f").alias("longer"), F.explode(_inside()).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    free = best.join(inside, ["lang", "phrase"], "left").filter(f"longer is null or 100 * longer < {int(share)} * b.a").select("lang", "phrase", "b.*")
    free = store.materialize(free, "scored")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a lang's first rows are among the first of its slices, which are as many as its phrases need
    slices = F.pmod(F.xxhash64("phrase"), F.lit(64 + free.count() // 100_000))
    first = free.withColumn("slice", slices).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir):
    return collocations(store.documents(spark, sf_dir, "lang", "text"))


ORACLE = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda w: w <> '') AS w FROM d
), spans AS (
  SELECT lang, w, unnest(range(1, 6)) AS k FROM pieces
), phrases AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM spans WHERE len(w) >= k
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM phrases GROUP BY ALL HAVING count(*) >= 100
), total AS (
  SELECT lang, count(*) AS n FROM phrases WHERE k = 1 GROUP BY lang
), cuts AS (
  SELECT lang, phrase, f AS a, k AS words, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS w FROM f WHERE k > 1
), scored AS (
  SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, n, cut, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN total t ON t.lang = c.lang
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, f, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' '))))) AS phrase
  FROM f WHERE k > 2
), free AS (
  SELECT b.* FROM best b LEFT JOIN (SELECT lang, phrase, max(f) AS f FROM inside GROUP BY ALL) i USING (lang, phrase) WHERE i.f IS NULL OR 100 * i.f < 100 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM free QUALIFY rank <= 2000
"""

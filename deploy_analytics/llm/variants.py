"""Spelling variant grouping by permuterm rotations (operator 11).

A word is marked with a terminator and rotated: a rotation starts anywhere and goes
round. Two words that differ in one replaced code point share all of the rotation that
ends with it but that code point; a word without one of its code points is, rotated to
the same place, all of that rotation but its end. So every rotation is entered once
whole and once without its last code point, entries are sorted, and the scan of the
sorted entries meets all neighbours of a kind side by side: a group has one whole
rotation at most and, besides, one entry for each code point that may have been
skipped, as many as the alphabet has.

A group emits one row for each of its entries, not its pairs: how many neighbours it
has there, and the most frequent of them. A replaced code point shows in one group
only. An inserted or deleted one shows once for each equal code point in a row, of
which the first is counted.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

RUN = re.compile("[A-Za-zÀ-ÿ]+")
MARK = "$"  #: the terminator, which no word has
DISTINCT = 400_000  #: words that a task counts before it hands the counts on
TEXT_KEY = 256  #: code points of a rotation that stands in its entry as text; a longer one stands there as a number
WHOLE, FIRST, AGAIN = 0, 1, 2  #: kinds of entries: a whole rotation; one without its last code point; the same, and the one before it is equal

#: Numbers for long rotations: polynomials over this base, modulo a Mersenne prime.
PRIME, BASE = (1 << 127) - 1, 0x5DEECE66D1CE4E5B9BF58476D1CE4E5B


def word_counts(docs: DataFrame, least_chars: int = 7, least: int = 2, change: Callable[[str, str], str] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z in lower case, with at least least_chars code points and least occurrences.

    change(key, run) may put another word in a run's place, the same one for all its
    occurrences in a row. Null texts have no runs, and a null key is an empty one. Rows
    count as often as they are there; other columns aren't read.
    """
    store.python_workers(docs.sparkSession)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for name, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for run, n in Counter(RUN.findall(whole.encode().lower().decode())).items():
                    word = change(name, run) if change else run
                    if len(word) >= least_chars:
                        counts[word] += n
                if len(counts) > DISTINCT:
                    yield rows()
                    counts.clear()
        yield rows()

    found = docs.select(F.coalesce(docs[key].cast("string"), F.lit("")).alias("key"), store.whole_text(docs, text).alias("text")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _numbers(word: str) -> Callable[[int, int], bytes]:
    """A function from start and upto to the number of word[start:] + MARK + word[:upto]; each costs the same, however long the word is."""
    head, power, size = [0], [1], len(word)
    for c in word:
        head.append((head[-1] * BASE + ord(c)) % PRIME)
        power.append(power[-1] * BASE % PRIME)

    def number(start: int, upto: int) -> bytes:
        tail = head[size] - head[start] * power[size - start]
        return b"%d#%d" % (size - start + 1 + upto, ((tail * BASE + ord(MARK)) * power[upto] + head[upto]) % PRIME)

    return number


def rotations(word: str) -> Iterator[tuple[bytes, int]]:
    """(key, kind) of all entries of a word: size + 1 whole rotations, and size without a code point of the word."""
    size = len(word)
    text = lambda start, upto: (word[start:] + MARK + word[:upto]).encode()
    number = _numbers(word) if size >= TEXT_KEY else text
    whole, skipping = (number if n > TEXT_KEY else text for n in (size + 1, size))
    for i in range(size + 1):
        yield whole(i, i), WHOLE
        if i < size:
            yield skipping(i + 1, i), AGAIN if i and word[i] == word[i - 1] else FIRST


def enter(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, kind, id, n) of rows (id, word, n)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            words = part.column(1).to_pylist()
            entries = [e for w in words for e in rotations(w)]
            times = np.array([2 * len(w) + 1 for w in words], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in entries], pa.binary()), pa.array(np.fromiter((kind for _, kind in entries), np.int8, len(entries)))]
                + [pa.array(np.repeat(part.column(c).to_numpy(zero_copy_only=False), times)) for c in (0, 2)],
                ["key", "kind", "id", "n"],
            )


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(group, kind, id, n) of sorted entries, whole groups at a time, those of one entry left out."""
    names = ["key", "kind", "id", "n"]
    rest = None

    def cut(table: pa.Table, upto: int, starts: np.ndarray):
        group = np.repeat(np.arange(len(starts)), np.diff([*starts, upto]))
        many = np.bincount(group, minlength=1)[group] > 1
        return (group[many], *(table.column(c).to_numpy()[:upto][many] for c in names[1:]))

    def starts_of(table: pa.Table) -> np.ndarray:
        key = table.column("key")
        return np.flatnonzero(np.concatenate([[True], pc.not_equal(key[1:], key[:-1]).to_numpy()]))

    for batch in batches:
        table = pa.Table.from_batches([batch.select(names)])
        table = (table if rest is None else pa.concat_tables([rest, table])).combine_chunks()
        if not table.num_rows:
            continue
        starts = starts_of(table)
        rest = table.slice(starts[-1])
        if starts[-1]:
            yield cut(table, int(starts[-1]), starts[:-1])
    if rest is not None and rest.num_rows:
        yield cut(rest, rest.num_rows, starts_of(rest))


def _neighbours(group: np.ndarray, kind: np.ndarray, own: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(id, near, best_n, best_id) of entries with neighbours: their number, and the most frequent, ties to the least id."""
    order = np.lexsort((own, -n, group))
    group, kind, own, n = (x[order] for x in (group, kind, own, n))
    size = int(group[-1]) + 1 if len(group) else 0
    skip, first = kind != WHOLE, kind == FIRST

    def leading(rows: np.ndarray, rank: int) -> np.ndarray:
        """By group, the place of its rank-th best among some rows, or -1."""
        at = np.flatnonzero(rows)
        begin = np.searchsorted(group[at], np.arange(size)) + rank
        found = np.full(size, -1)
        inside = begin < len(at)
        inside[inside] = group[at[begin[inside]]] == np.flatnonzero(inside)
        found[inside] = at[begin[inside]]
        return found

    one, two, whole, lead = leading(skip, 0)[group], leading(skip, 1)[group], leading(~skip, 0)[group], leading(first, 0)[group]
    place = np.arange(len(group))
    other = np.where(skip, np.where(one == place, two, one), lead)
    # a lower place in a group is a better neighbour: entries are sorted so
    indel = np.where(first, whole, -1)
    best = np.where((other < 0) | ((indel >= 0) & (indel < other)), indel, other)
    skips, firsts = (np.bincount(group[x], minlength=size)[group] for x in (skip, first))
    near = np.where(skip, skips - 1 + (indel >= 0), firsts)
    has = near > 0
    return own[has], near[has], n[best[has]], own[best[has]]


def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for columns in _groups(batches):
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in _neighbours(*columns)], ["id", "near", "best_n", "best_id"])


def _roots(links: DataFrame) -> DataFrame:
    """(id, root): where following forms from an id ends. Pointers are doubled, so rounds are the logarithm of the longest chain; n grows along one, so there are no circles."""
    now = store.materialize(links.select("id", F.col("form_id").alias("root")), "roots")
    while True:
        further = now.select(F.col("id").alias("root"), F.col("root").alias("further"))
        after = store.materialize(now.join(further, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        moved = not after.filter("moved").isEmpty()
        store.discard(now)
        now = after
        if not moved:
            return now.select("id", "root")


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """For distinct words (word, n): word, form, root, n, n_near, form_n.

    Near words differ by exactly one inserted, deleted or replaced code point; n_near
    counts them. A word's form is the near word of largest n (ties: the smallest in
    code-point order) if that is at least ratio times its own n, else null; root
    follows forms to the last and is the word itself without one. An empty table gives
    no rows. Words of any length cost in proportion to it: rotations beyond TEXT_KEY
    code points are compared as 127-bit numbers.
    """
    store.python_workers(words.sparkSession)
    named = words.select("word", "n").repartitionByRange("word").sortWithinPartitions("word").select(F.monotonically_increasing_id().alias("id"), "word", "n")
    named = store.materialize(named, "words")  # ids are in the order of the words
    entries = named.mapInArrow(enter, "key binary, kind byte, id long, n long")
    found = entries.repartition("key").sortWithinPartitions("key").mapInArrow(scan, "id long, near long, best_n long, best_id long")
    found = found.groupBy("id").agg(F.sum("near").alias("n_near"), F.max(F.struct("best_n", (-F.col("best_id")).alias("_id"))).alias("best"))
    rows = named.join(found, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("best.best_n") >= ratio * F.col("n"), F.struct((-F.col("best._id")).alias("id"), F.col("best.best_n").alias("n"))).alias("to"))
    rows = store.materialize(rows, "near")
    links = rows.filter("to is not null").select("id", F.col("to.id").alias("form_id"), F.col("to.n").alias("form_n"))
    links = links.join(_roots(links), "id")
    name = lambda c: named.select(F.col("id").alias(c), F.col("word").alias(c.removesuffix("_id")))
    links = links.withColumnRenamed("root", "root_id").join(name("form_id"), "form_id").join(name("root_id"), "root_id").select("id", "form", "root", "form_n")
    return rows.drop("to").join(links, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _thinned(key: str, run: str) -> str:
    """The run, or without one code point where 31 divides the checksum of key and run."""
    h = zlib.crc32(f"{key}:{run}".encode())
    if h % 31:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1 :]


def op11_spelling_variants(spark, sf_dir):
    docs = store.documents(spark, sf_dir, "doc_id", "text")
    return variants(word_counts(docs, change=_thinned))

"""LM scoring by a hashed maximum-entropy model with a class-factored softmax (operator 2).

P(word | history) = P(class | history) * P(leaf | class, history) * P(word | leaf).

Classes are ranges of equal mass among words ordered by their last two bytes, and
one for a document's end. Of each class the most frequent words have a leaf of their
own, the others share a few leaves by a hash. Both softmaxes have hashed features of
the history: the word before (n-gram) and the class of the word before that (skip),
and the class softmax both together too, each hashed into a fixed number of rows
of weights. So every frequent word has n-gram and skip weights of its own; words that
share a leaf have those of the leaf, and among themselves their add-one frequency,
with one share for a word never seen. The probabilities of all V known words, the end
and the unknown word of each shared leaf sum to 1.

Events are counted per (hashed word before, class before that, class), per (hashed
word before, leaf) and per (class before that, leaf): packed rows whose number the
hashing bounds, added up in two rounds. A gradient step over the whole corpus is one
Spark job over them. The weights of a hashed word before lie beside its events and are
moved there; of the weights that all share (biases, skips and pairs) partitions send
what they expect, a task adds it up, and the driver moves them.

Word counts are exact and over all training documents. Words of at least one in
``head_words`` tokens (there can't be more of them than that) are looked up in the
scoring tasks; rarer ones, none of which is hot, are joined.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

END = "\n"  #: the token that ends a document; no word contains it
CLASSES, WORD_ROWS, PAIR_ROWS = 64, 1024, 4096  #: classes with that of the end; rows of hashed words and hashed pairs
LEAVES, OWN = 64, 48  #: leaves of a class; those of them that are for one word
CELLS, PAIRS = CLASSES * LEAVES, CLASSES * CLASSES
ADDED = 400_000  #: counted words that a task adds up before it sends them on
SLICE = 4_000_000  #: bytes of text looked at together


@dataclass
class Tokens:
    """Tokens of some documents: codes into words, with the end after each document's own."""

    words: pa.Array
    codes: np.ndarray
    counts: np.ndarray  #: tokens of each document


def tokenize(texts: pa.Array) -> Tokens:
    """Words are runs of bytes other than space and \\t to \\r, in lower case A-Z."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
    flat = lists.flatten()
    lengths = np.diff(lists.offsets.to_numpy(zero_copy_only=False))
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    doc = np.repeat(np.arange(len(texts)), lengths)[real]
    encoded = flat.filter(pa.array(real)).dictionary_encode()
    n = np.bincount(doc, minlength=len(texts))
    codes = np.empty(len(doc) + len(texts), np.int32)
    ends = np.cumsum(n + 1) - 1
    codes[ends] = len(encoded.dictionary)
    codes[np.arange(len(doc)) + doc] = encoded.indices.to_numpy(zero_copy_only=False)
    return Tokens(pa.concat_arrays([encoded.dictionary, pa.array([END], pa.large_string())]), codes, n + 1)


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about SLICE bytes of text, one row at least."""
    size = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False)) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:  # taken, not sliced: ascii_lower misreads arrays with an offset
            yield batch.take(pa.array(np.arange(a, b)))


def endings(words: pa.Array) -> np.ndarray:
    """Last byte * 256 + the byte before it (0 if there is none)."""
    data = words.cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2], np.uint8)
    before = np.where(np.diff(offsets) > 1, raw[np.maximum(offsets[1:] - 2, 0)], 0)
    return raw[offsets[1:] - 1].astype(np.int64) * 256 + before


def hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode()) for w in words.to_pylist()), np.int64, len(words))


def pair_row(word_row: np.ndarray, skip: np.ndarray) -> np.ndarray:
    return (word_row * 2654435761 + skip * 40503) % 2**32 * PAIR_ROWS >> 32


@dataclass
class Leaves:
    """The class of each ending, the words with leaves of their own, and log10 of a leaf's share of one count."""

    of: np.ndarray
    own: pa.Array
    own_leaf: np.ndarray
    share: np.ndarray
    empty: np.ndarray  #: leaves without a known word, which have no probability

    def __call__(self, words: pa.Array, hashed: np.ndarray) -> np.ndarray:
        leaf = self.of[endings(words)] * LEAVES + OWN + (hashed >> 16) % (LEAVES - OWN)
        at = pc.index_in(words, value_set=self.own)
        found = at.is_valid().to_numpy(zero_copy_only=False)
        leaf[found] = self.own_leaf[at.drop_null().to_numpy()]
        return leaf


def make_classes(counts: DataFrame) -> np.ndarray:
    """The class of each ending: ranges of equal mass from (word, c); there are at most 65,536 endings."""
    b = F.col("word").cast("binary")
    byte = lambda k: F.conv(F.hex(F.substring(b, k, 1)), 16, 10).cast("int")
    ending = byte(-1) * 256 + F.when(F.octet_length("word") > 1, byte(-2)).otherwise(0)
    rows = counts.filter(F.col("word") != END).groupBy(ending.alias("ending")).agg(F.sum("c").alias("mass")).collect()
    mass = np.zeros(65536)
    for r in rows:
        mass[r.ending] = r.mass
    middle = np.cumsum(mass) - mass / 2
    of = np.minimum(middle * (CLASSES - 1) / max(mass.sum(), 1), CLASSES - 2).astype(np.int64)
    of[10 * 256] = CLASSES - 1  # END; no word ends in a line feed
    return of


def make_leaves(counts: DataFrame, head: pa.Array, head_counts: np.ndarray) -> Leaves:
    """Leaves from (word, c): of the head words the most frequent of each class by themselves, all others by hash."""
    of = make_classes(counts)
    words, c = head.filter(pc.not_equal(head, END)), head_counts[pc.not_equal(head, END).to_numpy(zero_copy_only=False)]
    cls = of[endings(words)]
    order = np.lexsort((np.arange(len(words)), -c, cls))
    rank = np.arange(len(words)) - np.searchsorted(cls[order], cls[order])
    chosen = order[rank < OWN]
    own = pa.concat_arrays([words.take(pa.array(chosen)), pa.array([END], pa.large_string())])
    leaves = Leaves(of, own, np.append(cls[chosen] * LEAVES + rank[rank < OWN], (CLASSES - 1) * LEAVES), np.zeros(CELLS), np.zeros(CELLS, bool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, kinds = np.zeros(CELLS), np.zeros(CELLS)
        for batch in batches:
            words = batch.column(0).cast(pa.large_string())
            leaf = leaves(words, hashes(words))
            mass += np.bincount(leaf, batch.column(1).to_numpy(), CELLS)
            kinds += np.bincount(leaf, minlength=CELLS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CELLS)), pa.array(mass), pa.array(kinds)], ["leaf", "mass", "kinds"])

    total, known = np.zeros(CELLS), np.zeros(CELLS)
    for r in counts.mapInArrow(run, "leaf long, mass double, kinds double").groupBy("leaf").agg(F.sum("mass").alias("mass"), F.sum("kinds").alias("kinds")).collect():
        total[r.leaf], known[r.leaf] = r.mass + r.kinds, r.kinds
    shared = np.arange(CELLS) % LEAVES >= OWN
    shared[-LEAVES:] = False  # the end is alone in its class
    leaves.empty = (known == 0) & ~shared
    leaves.empty[(CLASSES - 1) * LEAVES] = False
    leaves.share = -np.log10(np.maximum(total + shared, 1))
    return leaves


def contexts(t: Tokens, leaves: Leaves) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token: hashed word before, class of the one before that, own leaf. Before a document lie ends."""
    hashed = hashes(t.words)
    own = leaves(t.words, hashed)
    leaf, row = own[t.codes], (hashed % WORD_ROWS)[t.codes]
    first, end = np.cumsum(t.counts) - t.counts, hashed[-1] % WORD_ROWS
    before = np.concatenate([[end], row[:-1]])
    skip = np.concatenate([[CLASSES - 1, CLASSES - 1], leaf // LEAVES])[: len(leaf)]
    before[first] = end
    skip[first] = CLASSES - 1
    second = first[t.counts > 1] + 1
    skip[second] = CLASSES - 1
    return before, skip, leaf


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over all tokens of a column text."""
    names = ["word", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            for part in slices(batch, 0):
                t = tokenize(part.column(0))
                n = np.bincount(t.codes, minlength=len(t.words))
                kept.append(pa.RecordBatch.from_arrays([t.words, pa.array(n)], names))
                size += len(t.words)
                if size > ADDED:
                    kept = _added(kept)
                    size = sum(b.num_rows for b in kept)
                    if size > ADDED // 2:
                        yield from (pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1)], names) for b in kept)
                        kept, size = [], 0
        yield from (pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1)], names) for b in _added(kept))

    def _added(kept: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        if not kept:
            return []
        table = pa.Table.from_batches(kept).group_by("word", use_threads=False).aggregate([("c", "sum")])
        return table.select(["word", "c_sum"]).combine_chunks().to_batches()

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def count_events(docs: DataFrame, leaves: Leaves) -> DataFrame:
    """(row, n): for a hashed word before, counts by (class before that, class) and then by leaf; after WORD_ROWS rows, one by leaf for each class before that.

    n holds float32 values. There are WORD_ROWS + CLASSES rows at most, whatever the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task's text has fewer than 2 ** 31 tokens
        tables = np.zeros(WORD_ROWS * PAIRS, np.int32), np.zeros(WORD_ROWS * CELLS, np.int32), np.zeros(CLASSES * CELLS, np.int32)
        for batch in batches:
            for part in slices(batch, 0):
                before, skip, leaf = contexts(tokenize(part.column(0)), leaves)
                for table, at in zip(tables, ((before * CLASSES + skip) * CLASSES + leaf // LEAVES, before * CELLS + leaf, skip * CELLS + leaf), strict=True):
                    np.add.at(table, at, np.int32(1))
        one, two, three = (t.reshape(n, -1) for t, n in zip(tables, (WORD_ROWS, WORD_ROWS, CLASSES), strict=True))
        rows = [np.concatenate([x, y]) for x, y in zip(one, two, strict=True)] + list(three)
        at = [np.flatnonzero(x) for x in rows]
        found = [i for i, x in enumerate(at) if len(x)]
        cells, values = [at[i].astype(np.uint16).tobytes() for i in found], [rows[i][at[i]].astype(np.int64).tobytes() for i in found]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(cells, pa.binary()), pa.array(values, pa.binary())], ["row", "cells", "n"])

    def add(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple, np.ndarray] = {}
            for batch in batches:
                for row, salt, cells, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    table = sums.get((row, salt))
                    if table is None:
                        table = sums[row, salt] = np.zeros(PAIRS + CELLS, np.int64)
                    table[np.frombuffer(cells, np.uint16)] += np.frombuffer(n, np.int64)
            for (row, _), table in sums.items():
                at = np.flatnonzero(table)
                if last:
                    out = [pa.array([row], pa.int32()), pa.array([table.astype(np.float32).tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(out, ["row", "n"])
                else:
                    out = [pa.array([row], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([table[at].tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(out, ["row", "cells", "n"])

        return run

    # rows of many tasks are first added up in as many groups as there are tasks for them
    groups = max(1, int(float(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    counted = docs.select("text").mapInArrow(count, "row int, cells binary, n binary")
    salted = counted.select("row", (F.spark_partition_id() % groups).alias("salt"), "cells", "n").repartition("row", "salt")
    once = salted.mapInArrow(add(False), "row int, cells binary, n binary")
    return once.select("row", F.lit(0).alias("salt"), "cells", "n").repartition("row").mapInArrow(add(True), "row int, n binary")


@dataclass
class Weights:
    """Of the class softmax bias, word, skip and pair; of the softmax of leaves in a class the rest."""

    bias: np.ndarray
    word: np.ndarray
    skip: np.ndarray
    pair: np.ndarray
    leaf_bias: np.ndarray
    leaf_word: np.ndarray
    leaf_skip: np.ndarray

    @staticmethod
    def zeros(words: int = WORD_ROWS) -> Weights:
        """All weights, or those that all hashed words share (words: 0)."""
        classes = (np.zeros((n, CLASSES)) for n in (1, words, CLASSES, PAIR_ROWS))
        return Weights(*classes, *(np.zeros((n, CELLS), np.float32) for n in (1, words, CLASSES)))

    def class_log_softmax(self, w: int, word: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Logs of the classes' probabilities (skips x classes) after a hashed word with weights of its own."""
        z = self.bias + word + self.skip[skip] + self.pair[pair_row(np.full(len(skip), w), skip)]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def leaf_scores(self, leaf_word: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Weights of leaves (skips x classes x leaves of the class) after a hashed word; empty leaves have a very low bias."""
        return (self.leaf_bias + leaf_word + self.leaf_skip[skip]).reshape(len(skip), CLASSES, LEAVES)


STATE = ["kind", "row", "n", "leaf_word", "word", "data"]


def _move(w: np.ndarray, observed: np.ndarray, expected: np.ndarray, rate: float) -> None:
    w += 2 * rate * (observed - expected) / (observed + expected + 10)


def _step(given, rate: float):
    """For events with their words' weights (row, n, leaf_word, word) the same after a step, and what the shared weights (a broadcast) expect; without any, weights of zero and the observed counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, weights = Weights.zeros(0), given and given.value
        for batch in batches:
            rows = []
            for w, data, *own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = np.frombuffer(data, np.float32)
                if w >= WORD_ROWS:
                    out.leaf_skip[w - WORD_ROWS] += n[:CELLS]
                    continue
                counts = n[:PAIRS].reshape(CLASSES, CLASSES)
                skip = np.flatnonzero(counts.any(axis=1))
                seen = counts[skip].astype(np.float64)
                if weights is None:
                    leaf_word, word = np.zeros(CELLS, np.float32), np.zeros(CLASSES)
                else:
                    leaf_word, word = np.frombuffer(own[0], np.float32).copy(), np.frombuffer(own[1]).copy()
                    # scores stay far below what float32 holds, so none is shifted first
                    e = np.exp(weights.leaf_scores(leaf_word, skip))
                    e *= (counts[skip] / e.sum(axis=2))[:, :, None]
                    e = e.reshape(len(skip), CELLS)
                    out.leaf_skip[skip] += e
                    expected = np.exp(weights.class_log_softmax(w, word, skip)) * seen.sum(axis=1, keepdims=True)
                    _move(leaf_word, n[PAIRS:], e.sum(axis=0), rate)
                    _move(word, seen.sum(axis=0), expected.sum(axis=0), rate)
                    seen = expected
                out.bias[0] += seen.sum(axis=0)
                out.skip[skip] += seen
                np.add.at(out.pair, pair_row(np.full(len(skip), w), skip), seen)
                rows.append(("word", w, data, leaf_word.tobytes(), word.tobytes(), None))
            yield _state(rows)
        yield _state([("classes", 0, None, None, None, np.concatenate([out.bias, out.skip, out.pair]).tobytes()), ("skips", 0, None, None, None, out.leaf_skip.tobytes())])

    return run


def _state(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], STATE)


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of tables (kind, data)."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            table = np.frombuffer(data, np.float32 if kind == "skips" else np.float64)
            sums[kind] = sums[kind] + table if kind in sums else table
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([t.tobytes() for t in sums.values()], pa.binary())], ["kind", "data"])


def train(events: DataFrame, leaves: Leaves, steps: int = 12, rate: float = 0.3, partitions: int = 6) -> Weights:
    """Weights by gradient steps over all events; each step is one job.

    A step moves a weight by the difference of observed and expected counts over
    their mean, smoothed, so rare and frequent features learn alike. Each step is a
    table of events and of the weights of their words, which stay in their partitions;
    of all else one table of fixed size a step reaches the driver. However finely a
    table's files are split when they are read, no more than ``partitions`` tasks take
    the step, so no more tables of the shared weights are added up.
    """
    spark = events.sparkSession

    def stepped(rows: DataFrame, given) -> tuple[DataFrame, Weights]:
        table = store.materialize(rows.coalesce(partitions).mapInArrow(_step(given, rate), "kind string, row int, n binary, leaf_word binary, word binary, data binary"), "weights")
        total = Weights.zeros(0)
        for r in table.filter("kind <> 'word'").select("kind", "data").coalesce(1).mapInArrow(_added_up, "kind string, data binary").collect():
            if r.kind == "skips":
                total.leaf_skip += np.frombuffer(r.data, np.float32).reshape(CLASSES, CELLS)
            else:
                total.bias, total.skip, total.pair = np.split(np.frombuffer(r.data).reshape(-1, CLASSES), np.cumsum([1, CLASSES]))
        return table, total

    # a table of its own, so that no task has two Python workers
    dealt = store.materialize(events.coalesce(partitions), "events")
    table, observed = stepped(dealt, None)
    store.discard(dealt)
    weights = Weights.zeros(0)
    weights.bias[0] = np.log((observed.bias[0] + 1) / (observed.bias[0].sum() + CLASSES))
    by_leaf = observed.leaf_skip.sum(axis=0, dtype=np.float64).reshape(CLASSES, LEAVES)
    weights.leaf_bias[0] = np.log((by_leaf + 1) / (by_leaf.sum(axis=1, keepdims=True) + LEAVES)).ravel()
    weights.leaf_bias[0, leaves.empty] = -60.0
    words = lambda t: t.filter("kind = 'word'")
    for _ in range(steps):
        given, before = spark.sparkContext.broadcast(weights), table
        table, expected = stepped(words(before).select("row", "n", "leaf_word", "word"), given)
        given.destroy()  # of fixed size, and no longer needed
        store.discard(before)
        for name in ("bias", "skip", "pair", "leaf_skip"):
            _move(*(getattr(x, name) for x in (weights, observed, expected)), rate)
    weights.word, weights.leaf_word = np.zeros((WORD_ROWS, CLASSES)), np.zeros((WORD_ROWS, CELLS), np.float32)
    for r in words(table).select("row", "leaf_word", "word").toLocalIterator():
        weights.leaf_word[r.row], weights.word[r.row] = np.frombuffer(r.leaf_word, np.float32), np.frombuffer(r.word)
    store.discard(table)
    return weights


def score_tables(weights: Weights, leaves: Leaves) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 of the class's probability over the class's sum of leaves, by (word before, skip, class); then what a leaf adds by word before, and by skip."""
    every, first = np.arange(CLASSES), np.empty((WORD_ROWS, CLASSES, CLASSES), np.float32)
    for w in range(WORD_ROWS):
        first[w] = weights.class_log_softmax(w, weights.word[w], every) - np.log(np.exp(weights.leaf_scores(weights.leaf_word[w], every)).sum(axis=2))
    ten = np.float32(np.log(10))
    word = (weights.leaf_word + weights.leaf_bias) / ten + leaves.share.astype(np.float32)
    return (first / ten).ravel(), word.ravel(), (weights.leaf_skip / ten).ravel()


def score_texts(docs: DataFrame, train_on, text: str = "text", key: str = "doc_id", head_words: int = 1_000_000) -> DataFrame:
    """One row per row of docs: key, n_tokens, n_known, train_tokens, base_score, score.

    train_on is a condition that chooses the documents to learn from. base_score is
    the add-one unigram, score the model's log10 probability of the text. Null texts
    count as empty and have the end alone. Rows are told apart by a number of their
    own, so repeated or null keys do no harm; other columns are not read.
    """
    spark = docs.sparkSession
    store.python_workers(spark)
    train_docs = docs.filter(train_on).select(store.whole_text(docs, text).alias("text"))
    counts = store.materialize(count_words(train_docs), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least = max(2, -(-total // head_words))
    head = counts.filter(F.col("c") >= least).orderBy("word").toArrow()
    head_list, head_counts = head.column("word").combine_chunks().cast(pa.large_string()), head.column("c").to_numpy()
    head_log = np.log10(head_counts + 1.0)
    leaves = make_leaves(counts, head_list, head_counts)
    tables = spark.sparkContext.broadcast(score_tables(train(count_events(train_docs, leaves), leaves), leaves))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, by_word, by_skip = tables.value
        for batch in batches:
            for part in slices(batch, 2):
                t = tokenize(part.column(2))
                before, skip, leaf = contexts(t, leaves)
                start = np.cumsum(t.counts) - t.counts
                each = first[(before * CLASSES + skip) * CLASSES + leaf // LEAVES].astype(np.float64)
                each += by_word[before * CELLS + leaf]
                each += by_skip[skip * CELLS + leaf]
                model = np.add.reduceat(each, start)
                at = pc.index_in(t.words, value_set=head_list)
                found = at.is_valid().to_numpy(zero_copy_only=False)
                logs = np.zeros(len(t.words))
                logs[found] = head_log[at.drop_null().to_numpy()]
                known, sure = np.add.reduceat(found[t.codes].astype(np.int64), start), np.add.reduceat(logs[t.codes], start)
                n = part.num_rows
                rows = [part.column(0), part.column(1), pa.array(t.counts), pa.array(known), pa.array(sure), pa.array(model), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(rows, names)
                rare = ~found[t.codes]
                doc = np.repeat(np.arange(n), t.counts)[rare]
                pairs, times = np.unique(doc * len(t.words) + t.codes[rare], return_counts=True)
                doc, word = pairs // len(t.words), pairs % len(t.words)
                m, none = len(pairs), pa.nulls(len(pairs), pa.int64())
                rows = [part.column(0).take(pa.array(doc)), pa.nulls(m, part.column(1).type), none, none, pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()), t.words.take(pa.array(word)).cast(pa.string()), pa.array(times)]
                yield pa.RecordBatch.from_arrays(rows, names)

    names = ["rid", "key", "n_tokens", "known", "sure", "model", "word", "times"]
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"), store.whole_text(docs, text).alias("text"))
    scored = rows.mapInArrow(run, f"rid long, key {kind}, n_tokens long, known long, sure double, model double, word string, times long")
    scored = store.materialize(scored, "scored")
    tables.destroy()
    tail = scored.filter("word is not null").select("rid", "word", "times").join(counts.filter(F.col("c") < least), "word")
    tail = tail.groupBy("rid").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("rare"))
    whole = F.col("sure") + F.coalesce("rare", F.lit(0.0))
    return (
        scored.filter("word is null")
        .join(tail, "rid", "left")
        .select(
            F.col("key").alias(key),
            "n_tokens",
            (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"),
            (whole - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"),
            (whole + F.col("model")).alias("score"),
        )
    )


def op2_lm_score(spark, sf_dir):
    docs = store.documents(spark, sf_dir, "doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return score_texts(docs, ~held).withColumn("held_out", held)

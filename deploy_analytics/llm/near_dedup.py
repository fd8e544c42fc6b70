"""Near-duplicate classes by Order MinHash and banded alignment (operator 9).

A text is the sequence of its five-word shingles (words: runs of letters, digits
and underscores, in lower case). Each of 64 sketches takes the three shingles that
are least under its own hash, each labelled with its occurrence number, and keeps
them *in text order*: two texts agree in a sketch only if the same shingles come in
the same order. Two sketches make a band; texts that share a band are candidates.
At a similarity of 0.8 a sketch agrees with probability 0.51, so a pair misses all
32 bands with probability below 1e-4.

A candidate pair is a link if a banded alignment of the two shingle sequences
reaches 0.8: with L shingles aligned in order, L / (n + m - L) >= 0.8.

Large buckets never emit all their pairs. In a bucket of up to ``small_bucket``
texts all pairs are compared. In a larger one leaders are compared with all
others, and then, by an exact filter on their rarest shingles, all pairs that can
reach 0.8 and that no component of verified links joins (see ``banding``). Only links
within a component are left out, so classes are those of all candidate pairs.

Exact copies are collapsed first and share their text's class.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import banding, graph, store

WORD = re.compile(r"\w+")
SHINGLE, SKETCHES, PICK, ROWS = 5, 64, 3, 2  #: words a shingle; sketches; shingles a sketch; sketches a band
LEAST = 0.8  #: similarity of a link
AGREE = 16  #: of 64 sketches; at a similarity of 0.8 fewer agree with probability below 1e-4
CHUNK = 16384  #: shingles hashed at once, for texts of any length
MEMO = 400_000  #: word hashes a worker keeps
SLOT_BITS, PART = 18, 4096  #: bits of a hashed counter of shingles; counters a row
SLOTS = 1 << SLOT_BITS
RECENT = 32  #: texts whose shingles a verifying worker keeps

_odd = np.random.default_rng(20240229).integers(1, 2**63, SKETCHES + SHINGLE + PICK + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SKETCH, _PLACE, _ORDER, _LABEL = _odd[:SKETCHES, None], _odd[SKETCHES : SKETCHES + SHINGLE], _odd[-PICK - 1 : -1], _odd[-1]


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str, memo: dict) -> np.ndarray:
    """The text's shingles as 64-bit numbers, in order; one of all words if there are fewer than five."""
    words = WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(SHINGLE, len(h))):
        out += h[i : i + n] * _PLACE[i]
    out ^= out >> np.uint64(29)
    return out


def _labelled(k: np.ndarray) -> np.ndarray:
    """Shingles with their occurrence numbers mixed in."""
    order = np.argsort(k, kind="stable")
    s = k[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    if new.all():
        return k
    at = np.arange(len(s))
    occurrence = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty_like(k)
    out[order] = s + occurrence.astype(np.uint64) * _LABEL
    return out


def sketch(k: np.ndarray) -> np.ndarray:
    """64 order sketches of a shingle sequence, 32 bits each."""
    labelled, rows = _labelled(k), np.arange(SKETCHES)
    best_at, best = [], []
    for start in range(0, len(k), CHUNK):
        h = labelled[None, start : start + CHUNK] * _SKETCH
        for _ in range(min(PICK, h.shape[1])):
            at = h.argmin(axis=1)
            best_at.append(at + start)
            best.append(h[rows, at])
            h[rows, at] = np.iinfo(np.uint64).max
    at, h = np.stack(best_at, 1), np.stack(best, 1)
    if h.shape[1] > PICK:
        at = np.take_along_axis(at, np.argsort(h, 1, kind="stable")[:, :PICK], 1)
    at.sort(axis=1)
    out = (k[at] * _ORDER[: at.shape[1]]).sum(axis=1, dtype=np.uint64)
    out ^= out >> np.uint64(31)
    out *= _LABEL
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = _Hashes()
    for batch in batches:
        flat, lengths = [], []
        for text in batch.column("text").to_pylist():
            k = shingles(text, memo)
            if len(k):
                flat.append(sketch(k))
            lengths.append(SKETCHES if len(k) else 0)
        values = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
        keep = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], [*keep, "sketches"])


def similarity(a: list[int], b: list[int], least: float = LEAST) -> float:
    """L / (n + m - L) for the longest in-order alignment of L items, 0.0 if it is below least.

    An alignment that reaches least leaves out few items of each, so item i of a meets
    only items of b in a band around i. Rows are bit vectors as wide as the band, which
    move on by one item each step; what leaves them is final.
    """
    n, m = len(a), len(b)
    need = int(np.ceil(least * (n + m) / (1 + least) - 1e-9))
    if not n or not m or min(n, m) < need:
        return 0.0
    if need > sum((Counter(a) & Counter(b)).values()):
        return 0.0
    start = 0
    while start < min(n, m) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(n, m) - start and a[n - 1 - end] == b[m - 1 - end]:
        end += 1
    x, y = a[start : n - end], b[start : m - end]
    behind, width = n - need, n + m - 2 * need + 1  # item i meets i - behind and the width - 1 items after it
    matches, full = _matches(y), (1 << width) - 1
    row, left = full, 0
    for i, v in enumerate(x):
        if i:
            left += not row & 1
            row = row >> 1 | 1 << (width - 1)
        match = matches(v, i - behind, width)
        if match:
            u = row & match
            row = ((row + u) | (row - u)) & full
    aligned = start + end + left + width - row.bit_count()
    got = aligned / (n + m - aligned)
    return got if got >= least - 1e-12 else 0.0


def _matches(y: list[int]):
    """A function from a value, a first place and a width to the bits of the places in y there that have the value.

    A value in few places gives them by bisection. Those in more than the root of y's
    length are as few, and have all their places in one bit vector.
    """
    places: dict[int, list[int]] = {}
    for j, v in enumerate(y):
        places.setdefault(v, []).append(j)
    many: dict[int, int] = {}
    for v, js in places.items():
        if len(js) ** 2 > max(len(y), 1024):
            bits = np.zeros(len(y), np.uint8)
            bits[js] = 1
            many[v] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    def of(v: int, first: int, width: int) -> int:
        if v in many:
            return (many[v] >> first if first >= 0 else many[v] << -first) & ((1 << width) - 1)
        js, match = places.get(v, ()), 0
        for at in range(bisect_left(js, first), len(js)):
            if js[at] >= first + width:
                break
            match |= 1 << (js[at] - first)
        return match

    return of


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo, recent = _Hashes(), {}

    def shingled(text: str) -> list[int]:
        got = recent.pop(text, None)
        if got is None:
            got = shingles(text, memo).tolist()
            if len(recent) >= RECENT:
                del recent[next(iter(recent))]
        recent[text] = got  # the last one asked for is the last to go
        return got

    for batch in batches:
        found = [similarity(shingled(s), shingled(t)) for s, t in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], ["a", "b", "similarity"])


def _slots(k: np.ndarray) -> np.ndarray:
    return (k * _LABEL) >> np.uint64(64 - SLOT_BITS)


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashed counts of the texts' labelled shingles, in parts."""
    memo, counts = _Hashes(), np.zeros(SLOTS, np.int64)
    for batch in batches:
        for text in batch.column("text").to_pylist():
            np.add.at(counts, _slots(_labelled(shingles(text, memo))), 1)
    parts = [(i, p.tobytes()) for i, p in enumerate(counts.reshape(-1, PART)) if p.any()]
    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], ["part", "n"])


def _summed_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[part] = sums.get(part, 0) + np.frombuffer(n, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "n"])


def _first_tokens(counts: np.ndarray):
    """For (rep, c, text) the labelled shingles that come first: rare ones by the hashed counts, then by their value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in batches:
            of, sizes, tokens, at = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                k = _labelled(shingles(text, memo))
                first = len(k) - int(np.ceil(LEAST * len(k) - 1e-9)) + 1
                tokens.append(k[np.lexsort((k, counts[_slots(k)]))[:first]].view(np.int64))
                of.append(np.full(len(tokens[-1]), i))
                sizes.append(np.full(len(tokens[-1]), len(k)))
                at.append(np.arange(1, len(tokens[-1]) + 1))
            if of:
                flat = [pa.array(np.concatenate(x)) for x in (of, sizes, tokens, at)]
                own = [batch.column(c).take(flat[0]) for c in ("rep", "c")]
                yield pa.RecordBatch.from_arrays([*own, *flat[1:]], ["rep", "c", "n", "token", "at"])

    return run


def _text_ids(value):
    return [F.xxhash64(value).alias("t1"), F.xxhash64(F.lit(1), value).alias("t2")]


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", small_bucket: int = 16) -> tuple[DataFrame, DataFrame]:
    """Members (rid, key, t1, t2, rep, class) of all rows, and links (a, b, similarity) between distinct texts.

    rep numbers a distinct text, class is the least rep of its class. Null texts
    count as empty; texts without a word are alike only if equal. Rows are told apart by rid,
    so null or repeated keys do no harm, and other columns are not read.
    """
    spark = docs.sparkSession
    store.python_workers(spark)
    value = store.whole_text(docs, text)
    ids = _text_ids(value)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"), *ids, value.alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    signed = rows.mapInArrow(_sketches, f"rid long, key {kind}, t1 long, t2 long, sketches array<int>")
    signed = store.materialize(signed, "sketches")
    texts = signed.groupBy("t1", "t2").agg(F.min("rid").alias("rep"))
    texts = store.materialize(texts, "texts")
    reps = signed.join(texts.select("rep"), signed.rid == texts.rep).select("rep", "t1", "t2", "sketches").filter("size(sketches) > 0")
    reps = store.materialize(reps, "representatives")

    def texts_of(wanted: DataFrame, name: str) -> DataFrame:
        needed = wanted.join(reps.select("rep", "t1", "t2"), "rep")
        found = docs.select(*ids, value.alias("text")).join(needed, ["t1", "t2"]).groupBy(*wanted.columns).agg(F.first("text").alias("text"))
        return store.materialize(found, name)

    # shingles cost far more than a text's bytes tell: small tables are dealt over many tasks too
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def verify(pairs: DataFrame) -> DataFrame:
        found = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "candidate-texts")
        side = lambda x: found.select(F.col("rep").alias(x), F.col("text").alias(f"text_{x}"))
        met = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")
        met = met.repartition(tasks, "a", F.pmod("b", F.lit(16)))
        linked = store.materialize(met.mapInArrow(_verify, "a long, b long, similarity double").filter("similarity > 0"), "links")
        store.discard(found)
        return linked

    def first_tokens(wanted: DataFrame) -> DataFrame:
        found = texts_of(wanted, "open-texts").repartition(tasks, "rep")
        parts = found.mapInArrow(_token_counts, "part int, n binary").repartition("part").mapInArrow(_summed_counts, "part int, n binary")
        counts = np.zeros((SLOTS // PART, PART), np.int64)
        for r in parts.collect():  # SLOTS numbers, whatever the corpus
            counts[r.part] = np.frombuffer(r.n, np.int64)
        return found.mapInArrow(_first_tokens(counts.ravel()), "rep long, c long, n long, token long, at long")

    links = banding.links(reps.select("rep", "sketches"), SKETCHES, ROWS, AGREE, LEAST, verify, first_tokens, small_bucket)
    of = graph.components(links)
    classed = texts.join(of, texts.rep == of.node, "left").select("t1", "t2", "rep", F.coalesce("component", "rep").alias("class"))
    return store.materialize(signed.select("rid", "key", "t1", "t2").join(classed, ["t1", "t2"]), "members"), links


def _best(members: DataFrame) -> DataFrame:
    """Of each class its size and its row with the least key, nulls last."""
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "rid"))
    return store.materialize(members.groupBy("class").agg(first.alias("best"), F.count("*").alias("class_size")), "classes")


def near_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: key, class_id (least key of its class), class_size, kept.

    Of each class the row with the least key stays (of repeated keys one). Nulls come last.
    """
    members, _ = classes(docs, text, key)
    return (
        members.join(_best(members), "class").select(
            F.col("key").alias(key),
            F.col("best.key").alias("class_id"),
            "class_size",
            (F.col("rid") == F.col("best.rid")).alias("kept"),
        )
    )


def drop_near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs that near_dedup keeps, with all their columns, whatever their names."""
    members, _ = classes(docs, text, key)
    best = _best(members).select(F.col("best.rid").alias("rid"))
    kept = members.join(best, "rid").select("key", "t1", "t2")
    t1, t2 = _text_ids(store.whole_text(docs, text))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("k"), t1.alias("u1"), t2.alias("u2"))
    met = rows.join(kept, rows["k"].eqNullSafe(kept["key"]) & (rows["u1"] == kept["t1"]) & (rows["u2"] == kept["t2"]), "left_semi")
    return met.dropDuplicates(["k", "u1", "u2"]).select("row.*")


def op9_near_dedup(spark, sf_dir):
    return near_dedup(store.documents(spark, sf_dir, "doc_id", "text"))

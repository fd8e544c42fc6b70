"""Best-fit packing of token pieces by minimum bin slack (operator 1).

Lengths are whole numbers up to the capacity, so the state of the packing is a
histogram of at most ``capacity`` counts, whatever the number of pieces. A bin
starts with the longest length left; a subset-sum over the lengths still there, as
a bit set of reachable fills, finds the fullest combination for the rest, and the
combination is taken out as often as the counts allow. Combinations therefore
number a few thousand at most, while the bins they stand for are unlimited.

Pieces find their place by rank among those of their length: ranks come from counts
per (length, partition), so a length that a third of all pieces share is still
dealt over all partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store, tokens

CAPACITY = 2048
END = b"\0\0\0\0"  #: id 0 ends a document


@dataclass(frozen=True)
class Pattern:
    """A filling used for bins first .. first + times - 1: (length, how many of it) in order."""

    first: int
    times: int
    parts: tuple[tuple[int, int], ...]


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Of the combinations of counted lengths that fit in room, a fullest one; longer lengths are tried first."""
    reach, steps, goal = 1, [], 1 << room
    mask = (goal << 1) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left and not reach & goal:
            take = min(take, left)
            steps.append((reach, length, take))
            reach |= (reach << length * take) & mask
            left, take = left - take, take * 2
        if reach & goal:
            break
    fill, used = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> fill & 1:
            used[length] = used.get(length, 0) + take
            fill -= length * take
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Fillings that use up a histogram of lengths from 1 to capacity."""
    counts = {length: n for length, n in histogram.items() if n > 0}
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError("lengths must be from 1 to the capacity")
    out, bins = [], 0
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        used = fullest({k: n for k, n in counts.items() if n}, capacity - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in used.items())
        out.append(Pattern(bins, times, tuple(sorted(used.items(), reverse=True))))
        bins += times
        for k, n in used.items():
            counts[k] -= times * n
            if not counts[k]:
                del counts[k]
    return out


def _places(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first bin, pieces a bin, offset) by rank."""
    rows: dict[int, list] = {}
    taken: dict[int, int] = {}
    for p in patterns:
        offset = 0
        for length, n in p.parts:
            rows.setdefault(length, []).append((taken.get(length, 0), p.first, n, offset))
            taken[length] = taken.get(length, 0) + n * p.times
            offset += length * n
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (a column length, 1 to capacity) with sequence_id and offset added; other columns stay.

    Columns named sequence_id, offset, _part or _at are replaced. Equal rows are
    packed as often as they occur. An empty table stays empty.
    """
    store.python_workers(pieces.sparkSession)
    pieces = pieces.drop("sequence_id", "offset", "_part", "_at").withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    pieces = store.materialize(pieces, "pieces")
    counts = store.materialize(pieces.groupBy("length", "_part").agg(F.count("*").alias("n")), "piece-counts")
    # at most `capacity` rows
    histogram = {int(r.length): r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _places(plan(histogram, capacity))
    before = counts.select("length", "_part", (F.sum("n").over(Window.partitionBy("length").orderBy("_part")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "_part").orderBy("_at")) - 1
    ranked = pieces.withColumn("_rank", rank).join(before, ["length", "_part"]).withColumn("_rank", F.col("_rank") + F.col("before"))
    ranked = ranked.select(*(c for c in pieces.columns if c[0] != "_"), "_rank")

    def place(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for lengths, ranks in batches:
            lengths, ranks = lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
            out = np.zeros((2, len(lengths)), np.int64)
            order = np.argsort(lengths, kind="stable")
            values, starts = np.unique(lengths[order], return_index=True)
            for length, own in zip(values.tolist(), np.split(order, starts[1:]), strict=True):
                table, r = places[length], ranks[own]
                row = table[np.searchsorted(table[:, 0], r, side="right") - 1]
                k = r - row[:, 0]
                out[0, own] = row[:, 1] + k // row[:, 2]
                out[1, own] = row[:, 3] + k % row[:, 2] * length
            yield pa.StructArray.from_arrays([pa.array(out[0]), pa.array(out[1])], ["sequence_id", "offset"])

    placed = F.arrow_udf(place, "struct<sequence_id:long,offset:long>")
    out = ranked.withColumn("_place", placed(F.col("length").cast("long"), "_rank"))
    return out.select(*(c for c in ranked.columns if c != "_rank"), "_place.sequence_id", "_place.offset")


def token_pieces(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """(key, piece, start, length, ids_crc32, ids) of every document: its ids and a 0, cut only where they exceed the capacity.

    Null texts count as empty and give one piece, the 0. ids is left out unless asked for.
    """
    store.python_workers(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    size = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = tokens.word_memo(tokenizer)
        for batch in batches:
            of, number, length, crc, kept = [], [], [], [], []
            for i, ids in enumerate(tokens.word_ids(batch.column(1).to_pylist(), memo)):
                ids += END
                for at in range(0, len(ids), size):
                    part = ids[at : at + size]
                    of.append(i)
                    number.append(at // size)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(np.frombuffer(part, np.int32))
            columns = [batch.column(0).take(pa.array(of, pa.int64())), pa.array(number, pa.int32()), pa.array([capacity * n for n in number], pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [key, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *kept]))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(key), store.whole_text(docs, text).alias("_text")).mapInArrow(cut, schema)


def op1_best_fit_packing(spark, sf_dir, tokenizer: str | None = None):
    import public_tokenizers

    docs = store.documents(spark, sf_dir, "doc_id", "text")
    return pack(token_pieces(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), with_ids=False))

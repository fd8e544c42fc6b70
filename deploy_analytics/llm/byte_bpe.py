"""Byte-level BPE encoding and decoding (operator 3).

Encoding uses the tokenizers library over Arrow batches. Its alphabet is made of
characters, so the 256 bytes are mapped to printable characters, the ranks of the
vocabulary become merges in rank order, and each match of the splitting pattern is
encoded by itself. A worker encodes a match once and keeps its ids.

The library orders merges by pair, the ranks by joined token. The two can differ only
where two different pairs that join to the same token are open at once. Such a token
has three bytes at least and stands in the match twice, so the library decides every
match whose runs of three bytes are all different; the others are merged plainly by
rank.

Decoding reverses the byte table. Tokens may end inside a character: bytes are
joined before they are read as UTF-8, and in per-token output a split character
belongs to the token that completes it.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, tokens


def _merges(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Every way to join two tokens into one, in the order of the joined token's rank."""
    found = []
    for token, rank in ranks.items():
        cuts = [(token[:i], token[i:]) for i in range(1, len(token))]
        found += [(rank, *c) for c in cuts if c[0] in ranks and c[1] in ranks]
    found.sort(key=lambda x: x[0])
    return [(a, b) for _, a, b in found]


def by_rank(part: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids by joining, again and again, the leftmost neighbours whose joined token has the least rank.

    A heap holds the open pairs, so a match of n bytes takes n log n steps.
    """
    if part in ranks:
        return [ranks[part]]
    n = len(part)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the piece that starts at each place; end 0: joined to an earlier one
    open_pairs = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(part[i : i + 2])) is not None]
    heapq.heapify(open_pairs)

    def meet(i: int) -> None:
        if i >= 0 and end[i] < n and (rank := ranks.get(part[i : end[end[i]]])) is not None:
            heapq.heappush(open_pairs, (rank, i, end[end[i]]))

    while open_pairs:
        _, i, stop = heapq.heappop(open_pairs)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue  # one of the two has been joined since
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
        meet(before[i])
        meet(i)
    out, i = [], 0
    while i < n:
        out.append(ranks[part[i : end[i]]])
        i = end[i]
    return out


def ambiguous(part: bytes) -> bool:
    """Whether a run of three bytes occurs twice, so that the order of equal ranks may matter."""
    n = len(part) - 2
    return n > 1 and len({part[i : i + 3] for i in range(n)}) < n


class Codec:
    """Encoder and decoder of one rank file and splitting pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        tokens.limit_threads()
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.ranks = tokens.read_ranks(path)
        self.character = tokens.byte_characters()
        spell = lambda b: "".join(self.character[x] for x in b)
        model = models.BPE({spell(t): r for t, r in self.ranks.items()}, [(spell(a), spell(b)) for a, b in _merges(self.ranks)], ignore_merges=True)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.split = regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.memo = tokens.Memo(self._encode)

    def _encode(self, matches: list[str]) -> list[bytes]:
        out, plain = [b""] * len(matches), []
        for i, part in enumerate(m.encode() for m in matches):
            if ambiguous(part) and part not in self.ranks:
                out[i] = tokens.ids_bytes(by_rank(part, self.ranks))
            else:
                plain.append(i)
        for i, found in zip(plain, self.tokenizer.encode_batch_fast([matches[i] for i in plain], add_special_tokens=False), strict=True):
            out[i] = tokens.ids_bytes(found.ids)
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit bytes."""
        matches = self.split(text)
        self.memo.learn(set(matches))
        return b"".join(map(self.memo.__getitem__, matches))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, ids: list[int], text: str) -> tuple[list[int], list[int]]:
        """Start and end in code points of each token; a character that is split belongs to all its tokens."""
        lead = np.frombuffer(text.encode(), np.uint8) & 0xC0 != 0x80
        character = np.cumsum(lead) - 1
        ends = np.cumsum([len(self.bytes_of[i]) for i in ids], dtype=np.int64)
        starts = np.concatenate([[0], ends])[:-1]
        return character[starts].tolist() if len(ids) else [], (character[ends - 1] + 1).tolist() if len(ids) else []

    def pieces(self, ids: list[int]) -> list[str]:
        """The text of each token; bytes of a split character are held until it is complete."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        out = [reader.decode(self.bytes_of[i]) for i in ids]
        rest = reader.decode(b"", True)
        if rest:
            out[-1] += rest
        return out


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """docs with a column ids (array<int>), and with offsets also starts and ends in code points.

    Null texts count as empty and have no ids. Texts are encoded whole; other
    columns stay, columns of the new names are replaced.
    """
    store.python_workers(docs.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        for batch in batches:
            texts = batch.to_pylist()
            ids = [np.frombuffer(c.encode(t), np.int32) for t in texts]
            cuts = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))]
            if offsets:
                both = [c.offsets(x.tolist(), t) for x, t in zip(ids, texts, strict=True)]
                for k in (0, 1):
                    flat = np.array([v for pair in both for v in pair[k]], np.int32)
                    lists.append(pa.ListArray.from_arrays(cuts, pa.array(flat)))
            yield pa.StructArray.from_arrays(lists, ["ids", "starts", "ends"][: len(lists)])

    names = ["ids", "starts", "ends"] if offsets else ["ids"]
    found = F.arrow_udf(run, "struct<" + ",".join(f"{n}:array<int>" for n in names) + ">")(store.whole_text(docs, text))
    return docs.withColumn("_encoded", found).withColumns({n: F.col(f"_encoded.{n}") for n in names}).drop("_encoded")


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", per_token: bool = False) -> DataFrame:
    """df with a column decoded (binary), or with per_token pieces (array<string>) instead. Null ids decode to nothing."""
    store.python_workers(df.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        for batch in batches:
            lists = [x or [] for x in batch.to_pylist()]
            yield pa.array([c.pieces(x) for x in lists], pa.list_(pa.string())) if per_token else pa.array([c.decode(x) for x in lists], pa.binary())

    return df.withColumn("pieces" if per_token else "decoded", F.arrow_udf(run, "array<string>" if per_token else "binary")(F.col(ids)))


def round_trip_digests(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): every text encoded, its ids decoded again, without moving the ids out of the task."""
    store.python_workers(docs.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        for batch in batches:
            n, one, two = [], [], []
            for t in batch.to_pylist():
                ids = c.encode(t)
                n.append(len(ids) // 4)
                one.append(hashlib.sha256(ids).hexdigest())
                two.append(hashlib.sha256(c.decode(np.frombuffer(ids, "<u4").tolist())).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    found = F.arrow_udf(run, "struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>")(store.whole_text(docs, text))
    return docs.select(key, found.alias("_d")).select(key, "_d.*")


def op3_byte_bpe(spark, sf_dir, path: str | None = None):
    import public_tokenizers

    docs = store.documents(spark, sf_dir, "doc_id", "text")
    return round_trip_digests(docs, path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)

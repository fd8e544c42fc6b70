"""Secret scans over a trigram inverted index (operator 6).

Rules are regular expressions. From each one's syntax tree follows a Boolean query
over trigrams that every match must contain: literals in a row give a conjunction,
alternatives a disjunction. Each segment of documents (an Arrow batch) gets an
inverted index from those trigrams to its documents; a rule's postings are
intersected and united as its query says, and the rule is run on the documents
that remain. A rule without a mandatory trigram is run on every document.

Segments are indexed where they lie: nothing is shuffled, and the memory of a task
is that of one batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

SPANS = "array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = re.ASCII
    least: int = 0  #: characters that the group needs; a shorter match is dropped after it was found
    group: int = 0


# The kinds and their patterns, in the order in which ties are listed.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"sk_(?:live|test)_[0-9A-Za-z]{16,}"),
    Rule("github", r"github_pat_[0-9A-Za-z_]{22,}"),
)
BASE = ("assign", "access", "hex")


def trigram_query(pattern: str, flags: int = 0):
    """A trigram (bytes, A-Z in lower case), ("and", parts), ("or", parts), or None if nothing is mandatory."""

    def both(kind: str, parts: list):
        parts = [p for p in parts if p is not None] if kind == "and" else parts
        if not parts or None in parts:
            return None
        return parts[0] if len(parts) == 1 else (kind, tuple(dict.fromkeys(parts)))

    def walk(tree):
        parts, run = [], []

        def flush():
            literal = "".join(run).encode().lower()
            parts.extend(literal[i : i + 3] for i in range(len(literal) - 2))
            run.clear()

        for op, arg in tree:
            if op is sre.LITERAL:
                run.append(chr(arg))
                continue
            if op is sre.AT:
                continue
            flush()
            if op is sre.SUBPATTERN:
                parts.append(walk(arg[-1]))
            elif op is sre.BRANCH:
                parts.append(both("or", [walk(b) for b in arg[1]]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                parts.append(walk(arg[2]))
        flush()
        return both("and", parts)

    return walk(_parser.parse(pattern, flags))


def _trigrams(query) -> set[bytes]:
    if query is None:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(_trigrams, query[1]))


class SegmentIndex:
    """Postings of a segment's documents for the trigrams that the rules need."""

    def __init__(self, needed: list[bytes]):
        self.needed = needed
        self.number = np.zeros(1 << 24, np.uint8)
        for i, t in enumerate(needed):
            self.number[t[0] << 16 | t[1] << 8 | t[2]] = i + 1
        self.lower = np.arange(256, dtype=np.int32)
        self.lower[65:91] += 32

    def postings(self, texts: pa.Array) -> dict[bytes, np.ndarray]:
        """Trigram -> ascending positions of the documents that contain it."""
        data = texts.cast(pa.large_binary())
        offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        found: dict[bytes, np.ndarray] = {}
        if not len(data) or offsets[-1] - offsets[0] < 3:
            return found
        raw = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        low = self.lower[raw]
        which = self.number[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
        at = np.flatnonzero(which)
        ends = offsets[1:] - offsets[0]
        doc = np.searchsorted(ends, at, side="right")
        inside = at + 2 < ends[doc]
        pairs = np.unique(which[at[inside]].astype(np.int64) * len(data) + doc[inside])
        numbers, docs = pairs // len(data), pairs % len(data)
        cuts = np.searchsorted(numbers, np.arange(len(self.needed) + 2))
        return {t: docs[cuts[i + 1] : cuts[i + 2]] for i, t in enumerate(self.needed)}


def candidates(query, postings: dict[bytes, np.ndarray]) -> np.ndarray:
    """Documents that satisfy a trigram query."""
    if isinstance(query, bytes):
        return postings.get(query, np.zeros(0, np.int64))
    kind, parts = query
    sets = sorted((candidates(p, postings) for p in parts), key=len)
    out = sets[0]
    for s in sets[1:]:
        out = np.intersect1d(out, s, assume_unique=True) if kind == "and" else np.union1d(out, s)
    return out


def scanner(rules: tuple[Rule, ...] = RULES) -> Callable[[pa.Array], list[list[tuple[int, int, int]]]]:
    """A function from a segment's texts to (start, rule number, end) of each text's matches, in order."""
    if len({t for r in rules for t in _trigrams(trigram_query(r.pattern, r.flags))}) > 254:
        raise ValueError("the rules need more than 254 trigrams")
    compiled = [(re.compile(r.pattern, r.flags), trigram_query(r.pattern, r.flags), r) for r in rules]
    index = SegmentIndex(sorted({t for _, q, _ in compiled for t in _trigrams(q)}))

    def scan(texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        postings = index.postings(texts)
        whole = texts.to_pylist()
        out: list[list[tuple[int, int, int]]] = [[] for _ in whole]
        for number, (pattern, query, rule) in enumerate(compiled):
            for i in range(len(whole)) if query is None else candidates(query, postings):
                for m in pattern.finditer(whole[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[i].append((m.start(), number, m.end()))
        for spans in out:
            spans.sort()
        return out

    return scan


def scan_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with a column secrets: kind, start and end (code points, end exclusive) of each match.

    Matches of a rule don't overlap, leftmost first; they are listed by start, then in
    the order of rules. Null texts count as empty. Each row is scanned by itself, so
    repeated rows and other columns don't matter. A column named secrets is replaced.
    """
    store.python_workers(docs.sparkSession)

    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scan = scanner(rules)
        kinds = np.array([r.kind for r in rules], dtype=object)
        for batch in batches:
            found = scan(batch)
            flat = np.array([s for each in found for s in each], np.int32).reshape(-1, 3)
            parts = [pa.array(kinds[flat[:, 1]], pa.string()), pa.array(flat[:, 0]), pa.array(flat[:, 2])]
            offsets = np.concatenate([[0], np.cumsum([len(each) for each in found])]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, ["kind", "start", "end"]))

    return docs.withColumn("secrets", F.arrow_udf(spans, SPANS)(store.whole_text(docs, text)))


def redact_secrets(docs: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """docs with every secret in text replaced by a mask; overlapping matches get one. n_chars, if there, follows."""
    store.python_workers(docs.sparkSession)

    def redacted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scan = scanner()
        for batch in batches:
            out = []
            for whole, spans in zip(batch.to_pylist(), scan(batch), strict=True):
                parts, at = [], 0
                for start, _, end in spans:
                    if start >= at:
                        parts += [whole[at:start], mask]
                    at = max(at, end)
                out.append("".join(parts) + whole[at:])
            yield pa.array(out, pa.string())

    out = docs.withColumn(text, F.arrow_udf(redacted, "string")(store.whole_text(docs, text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return out


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secret_scan(spark, sf_dir):
    found = scan_secrets(store.documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "secrets")
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *(of(k).alias(f"n_{k}") for k in BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans")
    )

"""Toxicity by weak supervision (operator 8).

Voters are lexicon words and stems (word beginnings) that the labelled rows show
far more often in toxic texts, and a few fixed patterns. A generative label model
treats the true label as hidden: it estimates by EM how often each voter fires on
either class, measures how voters correlate beyond what the class explains, and
counts correlated voters for less. A given label is one more voter of fixed
accuracy. A linear classifier is then trained on the posterior labels, over voters
and hashed word beginnings, and scores every text.

Only the fit uses a sample: at most ``sample_rows`` labelled rows, those with the
least hash of their id. The model's size is fixed by parameters too. Scoring reads
every whole text once and shuffles nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

WORD = re.compile(r"\w+")
STEMS = (3, 4, 5, 6)  #: lengths of word beginnings
BUCKETS = 1024  #: hashed word beginnings of the classifier
MEMO = 300_000  #: words a worker remembers from one text to the next
LABEL_ACCURACY = 0.95  #: of a given label as a voter
PATTERNS = {
    "shouting": re.compile(r"\b[A-Z]{4,}\b(?:\W+[A-Z]{4,}\b){2}"),
    "exclaiming": re.compile(r"!{2,}"),
    "addressing": re.compile(r"\b(?:you|du|tu|vous)\s+(?:are|bist|es|êtes)\b", re.IGNORECASE),
}


@dataclass
class Model:
    """What scoring needs: voters by word or stem, their weights, and those of hashed stems."""

    voters: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(PATTERNS)))
    hashed: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))
    bias: float = -4.0


def bucket(word: str) -> int:
    return xxhash.xxh32_intdigest(word[:5]) % BUCKETS


class _Words(dict):
    """word -> weight of its hashed stem; hits has the voters of words that have any."""

    def __init__(self, voters: dict[str, int], hashed: np.ndarray):
        super().__init__()
        self.voters, self.hashed, self.hits = voters, hashed, {}

    def __missing__(self, word: str) -> float:
        fired = {v for k in STEMS if len(word) >= k and (v := self.voters.get(word[:k] + "*")) is not None}
        if (v := self.voters.get(word)) is not None:
            fired.add(v)
        if fired:
            self.hits[word] = fired
        w = self[word] = float(self.hashed[bucket(word)])
        return w

    def trim(self) -> None:
        """Forget the words if they are many; only between texts, so that none loses its hits."""
        if len(self) >= MEMO:
            self.clear()
            self.hits.clear()

    def fired(self, text: str, words: list[str]) -> set[int]:
        out: set[int] = set()
        for w in self.hits.keys() & set(words):
            out |= self.hits[w]
        n = len(self.voters)
        return out | {n + i for i, p in enumerate(PATTERNS.values()) if p.search(text)}


def _counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many toxic and other texts of a batch have each word and stem."""
    for frame in frames:
        both = (Counter(), Counter())
        for text, label in zip(frame["text"], frame["label"], strict=True):
            words = set(WORD.findall(text.lower()))
            both[label].update(words)
            both[label].update({w[:k] + "*" for w in words for k in STEMS if len(w) >= k})
        # a voter must be seen in toxic texts
        yield pd.DataFrame([(f, n, both[0].get(f, 0)) for f, n in both[1].items()], columns=["feature", "pos", "neg"])
        yield pd.DataFrame([(f, 0, n) for f, n in both[0].items() if f not in both[1]], columns=["feature", "pos", "neg"])


def mine_voters(sample: DataFrame, most: int = 200, precision: float = 0.95, surprise: float = 24.0) -> list[str]:
    """Words and stems that mark toxic texts, most frequent first.

    One needs a precision (at equal class sizes, smoothed by one text) and a
    likelihood ratio against chance that holds among many thousand words: some 6
    toxic texts and no other at a rate of one in ten. A word or stem whose own
    shorter stem is as precise is left out.
    """
    total = dict(sample.groupBy("label").count().collect())
    p, n = total.get(1, 0), total.get(0, 0)
    if not p or not n:
        return []
    counted = sample.select("text", "label").mapInPandas(_counts, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    pos, neg = F.col("pos"), F.col("neg")
    rate = (pos / p) / (pos / p + (neg + 1) / n)
    part = lambda x, share: F.when(x > 0, x * F.log(x / ((pos + neg) * share))).otherwise(0.0)
    ratio = 2 * (part(pos, p / (p + n)) + part(neg, n / (p + n)))
    found = counted.withColumn("rate", rate).filter((F.col("rate") >= precision) & (ratio >= surprise))
    rows = found.orderBy(F.desc("pos"), F.length("feature"), "feature").limit(10 * most).collect()
    kept: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (len(r.feature.rstrip("*")), r.feature)):
        stem = r.feature.rstrip("*")
        shorter = [kept[s] for k in STEMS if k < len(stem) + (r.feature[-1] != "*") and (s := stem[:k] + "*") in kept]
        if not shorter or max(shorter) < r.rate - 0.02:
            kept[r.feature] = r.rate
    return [r.feature for r in rows if r.feature in kept][:most]


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 15) -> np.ndarray:
    """Posterior of label 1 from 0/1 votes (rows x voters) and given labels, by EM.

    A voter that fires speaks by its firing rates in the two classes; one that
    doesn't abstains, but a last voter fires where no other does. Correlations
    within a class, as residuals from the rates, shrink the weights of voters that
    repeat one another.
    """
    votes = np.column_stack([votes, votes.sum(1) == 0]).astype(np.float32)
    q = np.where(labels == 1, LABEL_ACCURACY, 1 - LABEL_ACCURACY)
    given = np.where(labels == 1, 1.0, -1.0) * np.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY))
    for _ in range(rounds):
        prior = np.clip(q.mean(), 1e-4, 1 - 1e-4)
        one = (q @ votes + 0.5) / (q.sum() + 1)
        two = ((1 - q) @ votes + 0.5) / ((1 - q).sum() + 1)
        left = votes - (q[:, None] * one + (1 - q)[:, None] * two)
        left = left / np.maximum(np.sqrt((left**2).mean(0)), 1e-6)
        correlation = np.maximum(left.T @ left / len(votes), 0)
        weight = 1 / (1 + correlation.sum(1) - np.diag(correlation))
        odds = np.log(prior / (1 - prior)) + given + votes @ (weight * np.log(one / two))
        q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return q


def train_linear(votes: np.ndarray, shares: np.ndarray, target: np.ndarray, steps: int = 150):
    """Weights of votes and of hashed stems' shares, and bias, by full gradient steps on soft labels."""
    n, m = votes.shape
    w, b = np.zeros(m + BUCKETS), -2.0
    first, second = np.zeros(m + BUCKETS + 1), np.zeros(m + BUCKETS + 1)
    for t in range(1, steps + 1):
        z = votes @ w[:m].astype(np.float32) + shares @ w[m:].astype(np.float32) + b
        gap = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        narrow = gap.astype(np.float32)
        grad = np.concatenate([narrow @ votes + 1e-5 * w[:m], narrow @ shares + 1e-2 * w[m:], [gap.sum()]])
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        step = 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w[:m], w[m:], float(b)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(text, label) of at most sample_rows labelled rows outside the held-out fold."""
    chosen = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    chosen = chosen.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).filter("label in (0, 1)")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    met = docs.select("doc_id", store.whole_text(docs).alias("text")).join(F.broadcast(chosen), "doc_id")
    return store.materialize(met.select("text", "label"), "toxicity-sample")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 16_000) -> Model:
    """The model from at most sample_rows labelled rows; without labels of both kinds one that calls all texts clean."""
    store.python_workers(docs.sparkSession)
    sample = labelled_sample(docs, labels, sample_rows)
    voters = {f: i for i, f in enumerate(mine_voters(sample))}
    if not voters:
        return Model()

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _Words(voters, np.zeros(BUCKETS))
        for frame in frames:
            out = []
            for text, label in zip(frame["text"], frame["label"], strict=True):
                words = WORD.findall(text.lower())
                memo.trim()
                for w in words:
                    memo[w]
                c = Counter(bucket(w) for w in words)
                out.append((label, sorted(memo.fired(text, words)), np.array(list(c), np.int16).tobytes(), (np.array(list(c.values()), np.float32) / max(1, len(words))).tobytes()))
            yield pd.DataFrame(out, columns=["label", "fired", "cols", "shares"])

    # at most sample_rows rows: a matrix of 4 kB each
    got = sample.mapInPandas(features, "label int, fired array<int>, cols binary, shares binary").toPandas()
    votes = np.zeros((len(got), len(voters) + len(PATTERNS)), np.float32)
    shares = np.zeros((len(got), BUCKETS), np.float32)
    for i, (fired, cols, values) in enumerate(zip(got["fired"], got["cols"], got["shares"], strict=True)):
        votes[i, fired] = 1
        shares[i, np.frombuffer(cols, np.int16)] = np.frombuffer(values, np.float32)
    w, hashed, b = train_linear(votes, shares, label_model(votes, got["label"].to_numpy()))
    return Model(voters, w, hashed, b)


def _scored(docs: DataFrame, model: Model, text: str):
    """The score of a text column of docs."""
    store.python_workers(docs.sparkSession)

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = _Words(model.voters, model.hashed)
        for batch in batches:
            out = []
            for t in batch.to_pylist():
                words = WORD.findall(t.lower())
                memo.trim()
                z = model.bias + (sum(map(memo.__getitem__, words)) / len(words) if words else 0.0)
                z += sum(model.weights[i] for i in memo.fired(t, words))
                out.append(1 / (1 + np.exp(-min(max(z, -30), 30))))
            yield pa.array(out, pa.float64())

    return F.arrow_udf(scores, "double")(store.whole_text(docs, text))


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """docs with a column into (0 to 1), which replaces one of that name; null texts count as empty, other columns stay."""
    return docs.withColumn(into, _scored(docs, model, text))


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 16_000) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. Equal texts have equal scores.

    Only the text enters a score. A null doc_id is held out of nothing and learned from never.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, sample_rows))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the model doesn't call toxic, with all their columns as they are, whatever their names.

    Null and empty texts are scored as empty ones. Without labels of both kinds all rows stay.
    """
    return docs.filter(_scored(docs, fit(docs, labels), "text") < 0.5)


def op8_toxicity(spark, sf_dir):
    return toxicity(store.documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

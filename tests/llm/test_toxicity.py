import math
import random
import re
from collections import Counter

import numpy as np
import xxhash

from deploy_analytics.llm import toxicity as tx


def plain_score(model, text):
    """A text's score word by word, without any memory."""
    words = re.findall(r"\w+", (text or "").lower())
    fired = {i for f, i in model.voters.items() if (f in words if f[-1] != "*" else any(w.startswith(f[:-1]) for w in words))}
    fired |= {len(model.voters) + i for i, p in enumerate(tx.PATTERNS.values()) if p.search(text or "")}
    z = model.bias + sum(model.weights[i] for i in fired)
    z += sum(n * model.hashed[xxhash.xxh32_intdigest(w[:5]) % tx.BUCKETS] for w, n in Counter(words).items()) / max(1, len(words))
    return 1 / (1 + math.exp(-min(max(z, -30), 30)))


def plain_label_model(votes, labels, rounds):
    """The label model with loops."""
    rows = [[*map(float, v), float(not any(v))] for v in votes]
    n, m, a = len(rows), len(rows[0]), tx.LABEL_ACCURACY
    q = [a if x == 1 else 1 - a for x in labels]
    for _ in range(rounds):
        prior = min(max(sum(q) / n, 1e-4), 1 - 1e-4)
        one = [(sum(p * r[j] for p, r in zip(q, rows)) + 0.5) / (sum(q) + 1) for j in range(m)]
        two = [(sum((1 - p) * r[j] for p, r in zip(q, rows)) + 0.5) / (n - sum(q) + 1) for j in range(m)]
        left = [[r[j] - p * one[j] - (1 - p) * two[j] for j in range(m)] for p, r in zip(q, rows)]
        sd = [max(math.sqrt(sum(x[j] ** 2 for x in left) / n), 1e-6) for j in range(m)]
        cor = [[max(sum(x[i] * x[j] for x in left) / n / sd[i] / sd[j], 0) for j in range(m)] for i in range(m)]
        weight = [1 / (1 + sum(c) - c[j]) for j, c in enumerate(cor)]
        odds = [math.log(prior / (1 - prior)) + (1 if y == 1 else -1) * math.log(a / (1 - a)) + sum(r[j] * weight[j] * math.log(one[j] / two[j]) for j in range(m)) for r, y in zip(rows, labels)]
        q = [1 / (1 + math.exp(-min(max(o, -30), 30))) for o in odds]
    return q


def test_label_model_matches_plain_loops():
    r = random.Random(4)
    labels = np.array([int(r.random() < 0.3) for _ in range(120)])
    votes = np.array([[int(r.random() < (0.6 if y else 0.05)), int(r.random() < (0.5 if y else 0.1)), 0] for y in labels], np.float32)
    votes[:, 2] = votes[:, 0]  # a voter that repeats another
    got = tx.label_model(votes, labels, 6)
    assert np.abs(got - np.array(plain_label_model(votes, labels, 6))).max() < 1e-3
    flipped = labels.copy()
    flipped[np.flatnonzero((votes.sum(1) == 3) & (labels == 1))[0]] = 0
    assert tx.label_model(votes, flipped)[(flipped != labels)][0] > 0.05  # voters speak against a wrong label


def test_scores_match_plain_scoring_and_hold_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = tx.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = {r.doc_id: r for r in tx.op8_toxicity(spark, "/root/testdata/sf0.01").collect()}
    assert rows.keys() == texts.keys()
    assert all(abs(rows[k].score - plain_score(model, t)) < 1e-9 for k, t in texts.items())
    assert all(r.predicted == int(r.score >= 0.5) for r in rows.values())
    known = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    held = [k for k in known if rows[k].held_out]
    assert sum(rows[k].predicted == known[k] for k in held) >= 0.95 * len(held)


def test_many_distinct_words_keep_their_votes(spark):
    model = tx.Model({"badword": 0}, np.array([10.0, 0.0, 0.0, 0.0]))
    filler = " ".join(f"w{i}" for i in range(tx.MEMO))
    rows = [(1, "badword"), (2, f"badword {filler}"), (3, filler), (4, "badword")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    high = {r.doc_id: r.score > 0.5 for r in tx.score(docs, model).collect()}
    assert high == {1: True, 2: True, 3: False, 4: True}


def made(n=400):
    r = random.Random(1)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(n):
        text = r.choices(words, k=30) + (["vilething", "nastystuff"] if i % 4 == 0 else [])
        rows.append((i, " ".join(text), i % 4 == 0))
    return rows


def test_edge_cases(spark):
    rows = made()
    schema = "doc_id long, text string, score double, label int"
    docs = [(k, t, 7.0, 3) for k, t, _ in rows] + [(None, None, 7.0, 3), (500, "", 7.0, 3), (501, "vilething nastystuff " + "calm " * 30_000, 7.0, 3), (1, rows[1][1], 7.0, 3), (None, "vilething nastystuff", 7.0, 3)]
    docs = spark.createDataFrame(docs, schema)
    labels = spark.createDataFrame([(k, int(y), None) for k, _, y in rows] + [(None, 1, None), (9, None, None), (4, 1, None), (10**6, 1, None)], "doc_id long, toxic int, text string")
    found = tx.toxicity(docs, labels).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    assert {r.score for r in found if r.doc_id == 1} == {next(r.score for r in found if r.doc_id == 1)}
    assert sum(r.predicted != (r.doc_id % 4 == 0) for r in found if r.doc_id is not None and r.doc_id < 400) == 0
    assert [r.predicted for r in found if r.doc_id is None] == [0, 1] and [r.held_out for r in found if r.doc_id is None] == [False, False]
    left = tx.drop_toxic(docs, labels)
    assert left.columns == docs.columns and {r.score for r in left.collect()} == {7.0}
    assert left.count() == sum(r.predicted == 0 for r in found)
    assert tx.toxicity(docs.limit(0), labels).count() == 0 and tx.drop_toxic(docs, labels.limit(0)).count() == docs.count()
    assert [tuple(r) for r in tx.drop_toxic(docs.filter("doc_id = 3"), labels).select("doc_id").collect()] == [(3,)]

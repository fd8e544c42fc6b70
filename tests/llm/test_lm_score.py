import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from deploy_analytics.llm import lm_score as lm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), lm.END]


def expected(docs):
    """doc_id -> n_tokens, n_known, train_tokens, base_score by the formula."""
    c = Counter(w for k, t in docs if k is None or zlib.crc32(str(k).encode()) % 7 != 2 for w in words(t))
    n, v = sum(c.values()), len(c)
    return [(k, len(ws := words(t)), sum(w in c for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for k, t in docs]


def test_query_matches_formula_and_beats_base(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows = {r.doc_id: r for r in lm.op2_lm_score(spark, "/root/testdata/sf0.01").collect()}
    assert len(rows) == len(docs)
    for k, n, known, total, base in expected(docs):
        r = rows[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
        assert r.held_out == (zlib.crc32(str(k).encode()) % 7 == 2)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_slices_do_not_change_counts(spark, monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array(["Á the é", "", "  B\tã the", None or "x"] * 50)], ["text"])
    monkeypatch.setattr(lm, "SLICE", 40)
    parts = [lm.tokenize(p.column(0)) for p in lm.slices(batch, 0)]
    assert len(parts) > 20
    whole = lm.tokenize(batch.column(0))
    spell = lambda t: t.words.take(pa.array(t.codes)).to_pylist()
    assert [w for p in parts for w in spell(p)] == spell(whole)


def test_small_head_gives_the_same_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    one = {r.doc_id: r for r in lm.score_texts(docs, F.col("doc_id") % 3 != 0).collect()}
    two = {r.doc_id: r for r in lm.score_texts(docs, F.col("doc_id") % 3 != 0, head_words=20).collect()}
    assert one.keys() == two.keys()
    for k in one:
        assert one[k].n_known == two[k].n_known and abs(one[k].base_score - two[k].base_score) < 1e-6


def fitted(spark, texts, steps=4):
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    by = {r.word: r.c for r in lm.count_words(docs).collect()}
    counts = spark.createDataFrame(list(by.items()), "word string, c long")
    head = [w for w, c in by.items() if c >= 2]
    leaves = lm.make_leaves(counts, pa.array(head, pa.large_string()), np.array([by[w] for w in head]))
    events = lm.count_events(docs, leaves)
    return by, leaves, events, lm.train(events, leaves, steps=steps)


TEXTS = ["the cat saw the dog", "a dog saw a bird.", "le chat voit le chien", "une vache"] * 5 + ["rare words", "others too"]


def test_probabilities_sum_to_one(spark):
    by, leaves, _, weights = fitted(spark, TEXTS)
    first, by_word, by_skip = lm.score_tables(weights, leaves)
    words = pa.array(list(by), pa.large_string())
    leaf = leaves(words, lm.hashes(words))
    unknown = np.flatnonzero((np.arange(lm.CELLS) % lm.LEAVES >= lm.OWN) & (np.arange(lm.CELLS) < lm.CELLS - lm.LEAVES))
    for w, s in ((5, 3), (700, 12), (1023, 63)):
        p = lambda at: 10.0 ** (first[(w * lm.CLASSES + s) * lm.CLASSES + at // lm.LEAVES] + by_word[w * lm.CELLS + at] + by_skip[s * lm.CELLS + at])  # noqa: E731, B023
        assert abs((p(leaf) * (np.array(list(by.values())) + 1)).sum() + p(unknown).sum() - 1) < 1e-4


def test_events_and_one_step_match_plain_loops(spark):
    """Counts by plain loops, and one gradient step of the weights by the formula."""
    by, leaves, events, weights = fitted(spark, TEXTS, steps=1)
    row = lambda w: zlib.crc32(w.encode()) % lm.WORD_ROWS
    leaf_of = lambda w: int(leaves(pa.array([w], pa.large_string()), lm.hashes(pa.array([w], pa.large_string())))[0])
    seen = Counter()
    for t in TEXTS:
        history = [lm.END, lm.END]
        for w in words(t):
            seen[row(history[-1]), leaf_of(history[-2]) // lm.LEAVES, leaf_of(w)] += 1
            history.append(w)
    got = {r.row: np.frombuffer(r.n, np.float32) for r in events.collect()}
    for r in {k[0] for k in seen}:
        one, two = np.zeros((lm.CLASSES, lm.CLASSES)), np.zeros(lm.CELLS)
        for (w, s, leaf), n in seen.items():
            if w == r:
                one[s, leaf // lm.LEAVES] += n
                two[leaf] += n
        assert (got[r][: lm.PAIRS] == one.ravel()).all() and (got[r][lm.PAIRS :] == two).all()
    bias = np.zeros(lm.CELLS)
    for (_, _, leaf), n in seen.items():
        bias[leaf] += n
    bias = np.log((bias.reshape(lm.CLASSES, -1) + 1) / (bias.reshape(lm.CLASSES, -1).sum(1, keepdims=True) + lm.LEAVES)).ravel()
    bias[leaves.empty] = -60
    observed, expected = Counter(), Counter()
    for (w, s, leaf), n in seen.items():
        observed[w, leaf] += n
        c = leaf // lm.LEAVES
        share = np.exp(bias[c * lm.LEAVES : (c + 1) * lm.LEAVES])
        for k, q in enumerate(share / share.sum()):
            expected[w, c * lm.LEAVES + k] += n * q
    for (w, leaf), e in expected.items():
        o = observed[w, leaf]
        assert abs(weights.leaf_word[w, leaf] - 0.6 * (o - e) / (o + e + 10)) < 1e-4


def test_weights_of_words_stay_in_partitions(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(lm.np, "frombuffer", lambda data, *kind: sizes.append(len(data) * (len(data) >= 8 * lm.CLASSES)) or frombuffer(data, *kind))
    weights = fitted(spark, TEXTS, steps=3)[3]
    shared = 8 * lm.CLASSES * (1 + lm.CLASSES + lm.PAIR_ROWS) + 4 * lm.CLASSES * lm.CELLS
    words = (weights.word != 0).any(axis=1).sum()
    # the driver gets one sum of the shared tables for the observed counts and each step, and the words' weights once
    assert sum(sizes) == 4 * shared + words * (4 * lm.CELLS + 8 * lm.CLASSES) and words > 5


def test_finely_split_files_make_no_more_shared_tables(spark, monkeypatch):
    tables, write = [], lm.store.materialize

    def counted(df, name):
        out = write(df, name)
        if name == "weights":
            tables.append(out.filter("kind = 'classes'").count())
        return out

    monkeypatch.setattr(lm.store, "materialize", counted)
    split = {"spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in split}
    try:
        for k, v in split.items():
            spark.conf.set(k, v)
        fitted(spark, TEXTS, steps=1)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(tables) == 2 and max(tables) <= 6


frombuffer = np.frombuffer


def test_a_frequent_word_learns_its_neighbour(spark):
    r = np.random.default_rng(1)
    texts = [" ".join(f"{a} {'left' if a == 'alpha' else 'right'}" for a in r.choice(["alpha", "beta", "gamma"], 20)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(100, "alpha left"), (101, "alpha right"), (102, "beta right"), (103, "beta left")], "doc_id long, text string")
    got = {x.doc_id: x for x in lm.score_texts(docs, F.col("doc_id") < 100).collect()}
    assert got[100].score > got[101].score + 0.5 and got[102].score > got[103].score + 0.5
    assert got[100].score > got[100].base_score


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "A b\x0bA"), (4, "word " * 40_000), (4, "word " * 40_000), (8, "  x ")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in lm.score_texts(docs, F.lit(True)).collect())
    assert got == [(0, 4), (1, 1), (2, 1), (4, 40_001), (4, 40_001), (8, 2)]
    assert lm.score_texts(docs.limit(0), F.lit(True)).count() == 0
    assert all(r.n_known == 0 or r.doc_id for r in lm.score_texts(docs, F.lit(False)).collect())

import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from deploy_analytics.llm import collocation as co

DOCS = "lang string, text string"


def plain_counts(docs, longest=5):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return f, n


def plain(docs, least=100, longest=5, top=2000, share=100):
    """The contract in plain loops, without pruning."""
    f, n = plain_counts(docs, longest)
    out = set()
    for lang, own in f.items():
        cands = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in cands.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        rows = []
        for p, a in cands.items():
            if 100 * inside[p] >= share * a:
                continue
            score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def mined(spark, docs, **more):
    return [tuple(r) for r in co.collocations(spark.createDataFrame(docs, DOCS), **more).collect()]


@pytest.mark.parametrize(("least", "top", "share", "budget"), [(20, 50, 100, 8), (5, 2000, 90, 4096), (100, 2000, 100, 2)])
def test_against_plain_loops(spark, least, top, share, budget):
    docs = [(r.lang, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = mined(spark, docs, least=least, top=top, share=share, budget=budget)
    assert len(got) == len({*got}) and {*got} == plain(docs, least, 5, top, share)
    assert least == 100 or len(got) > 50


def test_a_hot_phrase_is_split_by_longer_prefixes(spark):
    draw = random.Random(5)
    docs = [(None, " ".join(["of", "the", draw.choice("abcdef"), draw.choice("uvwxyz"), draw.choice("klmno")] * 3)) for _ in range(400)] + [("und", "of the. end")] * 120
    leaves = spark.createDataFrame([("und", f"of the {a} {b} {c}", 1) for a in "abcdef" for b in "uvwxyz" for c in "klmno"], "lang string, phrase string, n long")
    depths = {r.depth: r["count"] for r in co.with_prefixes(leaves, 5, 4).groupBy("depth").count().collect()}
    assert depths == {5: 180}  # 180, 30 and 5 leaves are over the budget of 4
    got = mined(spark, docs, least=10, budget=4)
    assert {*got} == plain(docs, least=10) and len(got) > 100


def test_subtree_counts_are_sums_of_leaves():
    leaves = sorted([(["a", "b"], 3), (["a", "b", "c"], 2), (["a", "b\x01"], 5), (["a", "d"], 1), (["x", "y", "z"], 4)])
    assert {" ".join(w): n for w, n in co.subtree(leaves)} == {"a": 11, "a b": 5, "a b c": 2, "a b\x01": 5, "a d": 1, "x": 4, "x y": 4, "x y z": 4}
    assert list(co.subtree([])) == []


SOME = st.lists(st.tuples(st.sampled_from(["en", None, ""]), st.one_of(st.none(), st.text("aAbé .,\t\n \x1c", max_size=60))), max_size=12)


@settings(max_examples=5, deadline=None)
@given(SOME)
def test_any_texts(spark, docs):
    got = mined(spark, docs * 3, least=3, budget=3) if docs else []
    assert {*got} == plain(docs * 3, least=3)


def test_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(co, "CHUNK", 100)
    long = "The Cat sat on " * 30_000
    rows = [("en", long, 1, "x"), ("en", None, 2, "y"), ("en", "", 3, None), ("en", "a" * 200_000, 4, "z"), (None, "p q. p q;" * 60, 5, "w"), (None, "p q. p q;" * 60, 5, "w")]
    df = spark.createDataFrame(rows, DOCS + ", n long, phrase string")
    got = [tuple(r) for r in co.collocations(df).collect()]
    assert {*got} == plain([r[:2] for r in rows])
    assert ("und", 1, "p q", 240, 240, 240, 480, 2000) in got
    assert co.collocations(df.limit(0)).collect() == []
    assert [w for part in co._parts(b"aa.bb.cc" * 60) for w in part.split(b".")] == (b"aa.bb.cc" * 60).split(b".")

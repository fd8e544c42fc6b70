from collections import defaultdict
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st

from deploy_analytics.llm import near_dedup as nd


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute(rows):
    """Classes by all pairs that share a shingle; equal texts are one."""
    memo = nd._Hashes()
    texts = {}
    for key, text in rows:
        texts.setdefault(text or "", []).append(key)
    ids = list(texts)
    seqs = [nd.shingles(t, memo).tolist() for t in ids]
    inverse = defaultdict(set)
    for i, s in enumerate(seqs):
        for x in s:
            inverse[x].add(i)
    pairs = {p for x in inverse.values() for p in combinations(sorted(x), 2)}
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        a, b = seqs[i], seqs[j]
        if min(len(a), len(b)) < 0.8 * max(len(a), len(b)) or len(set(a) & set(b)) < 0.6 * len(set(a)):
            continue
        n = lcs(a, b)
        if n / (len(a) + len(b) - n) >= 0.8 - 1e-12:
            root[max(find(i), find(j))] = min(find(i), find(j))
    out = defaultdict(set)
    for i, t in enumerate(ids):
        out[find(i)].update(texts[t])
    return {frozenset(x) for x in out.values()}


def got(df):
    out = defaultdict(set)
    for r in df.collect():
        out[r.class_id].add(r.doc_id)
    return {frozenset(x) for x in out.values()}


def test_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    result = nd.near_dedup(docs).collect()
    assert sum(r.kept for r in result) == len({r.class_id for r in result})
    assert got(nd.near_dedup(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_edge_cases(spark):
    base = " ".join(f"w{i}" for i in range(120))
    edited = base.replace("w60 ", "x60 ")
    rows = [(1, base, "a"), (1, base, "b"), (2, edited, None), (None, base, "c"), (3, None, "d"), (4, "", "e"), (5, "one two", "f"), (6, "One, two!", "g"), (7, "!!", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class string")
    by = {(r.doc_id, r.class_id, r.class_size) for r in nd.near_dedup(docs).collect()}
    assert by == {(1, 1, 4), (2, 1, 4), (None, 1, 4), (3, 3, 2), (4, 3, 2), (5, 5, 2), (6, 5, 2), (7, 7, 1)}
    assert sorted(r.doc_id for r in nd.drop_near_copies(docs).collect()) == [1, 3, 5, 7]
    assert nd.near_dedup(docs.limit(0)).count() == 0


def test_large_bucket_is_one_class(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[: 2 * i], f"new{i}", *base[2 * i + 1 :]])) for i in range(60)]
    result = nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in result} == {0}


def test_similarity_is_the_aligned_share():
    import random

    random.seed(3)
    for _ in range(200):
        a = [random.randrange(30) for _ in range(random.randrange(1, 60))]
        b = [x for x in a if random.random() > 0.1] + [99] * random.randrange(3)
        n = lcs(a, b)
        s = n / (len(a) + len(b) - n)
        assert abs(nd.similarity(a, b) - (s if s >= 0.8 else 0)) < 1e-9


def test_long_text_sketches_do_not_depend_on_chunks(monkeypatch):
    memo = nd._Hashes()
    k = nd.shingles(" ".join(f"w{i % 700}" for i in range(5000)), memo)
    whole = nd.sketch(k)
    monkeypatch.setattr(nd, "CHUNK", 64)
    assert (nd.sketch(k) == whole).all()


def test_large_buckets_lose_no_class(spark):
    import random

    r = random.Random(11)
    words = lambda n: [f"v{r.randrange(10**6)}" for _ in range(n)]
    passage, texts = words(115), []
    for _ in range(60):
        own = words(35)
        texts += [[*passage, *own], [*passage, *own[:32], *words(3)]]
    rows = [(i, " ".join(x)) for i, x in enumerate(texts)]
    members, _ = nd.classes(spark.createDataFrame(rows, "doc_id long, text string"), small_bucket=4)
    found = defaultdict(set)
    for m in members.collect():
        found[m["class"]].add(m.key)
    want = brute(rows)
    assert {frozenset(x) for x in found.values()} == want and len(want) == 60


def test_alignment_costs_the_band_not_the_places_of_a_shingle():
    import time

    n = 20_000
    for a in ([1] * n, [i % 10 for i in range(n)]):
        b = [*a]
        a[7], b[n - 9], b[n // 2] = -1, -2, -3
        began = time.process_time()
        assert nd.similarity(a, b) > 0.99
        assert time.process_time() - began < 2  # some 0.05 s; the quadratic form took fifty


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.lists(st.tuples(st.integers(0, 60), st.sampled_from("ird"), st.integers(0, 3)), max_size=8))
def test_alignment_of_edited_sequences(a, edits):
    b = [*a]
    for at, kind, value in edits:
        if kind == "i":
            b.insert(at, value)
        elif b:
            at = min(at, len(b) - 1)
            b[at : at + 1] = [value] if kind == "r" else []
    aligned = lcs(a, b)
    want = aligned / max(1, len(a) + len(b) - aligned)
    assert abs(nd.similarity(a, b) - (want if want >= nd.LEAST - 1e-12 else 0.0)) < 1e-12

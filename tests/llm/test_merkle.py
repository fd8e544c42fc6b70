import hashlib
import re

import xxhash

from deploy_analytics.llm import merkle


def tree(text):
    """The fingerprint, written once more in Python."""
    h = lambda kind, parts: hashlib.sha256((kind + "".join(parts)).encode()).hexdigest()
    sections = []
    for s in re.findall(merkle.SECTION.replace(r"\z", r"\Z"), text):
        paragraphs, leaves = [], []
        for p in re.findall(merkle.PARAGRAPH, s):
            own = [(h("leaf", [x]), len(x)) for x in re.findall(merkle.LEAF, p)]
            paragraphs.append(h("paragraph", [d for d, _ in own]))
            leaves += own
        sections.append((h("section", paragraphs), leaves))
    root = h("root", [d for d, _ in sections])
    return root + "".join(f"|{d[:16]}:" + ",".join(f"{x[:16]}{n}" for x, n in leaves) for d, leaves in sections), [x for _, ls in sections for x in ls]


def likeness(a, b):
    (fa, la), (fb, lb) = tree(a), tree(b)
    if fa[:64] == fb[:64]:
        return 1.0
    return 2 * sum(n for _, n in set(la) & set(lb)) / max(1, sum(n for _, n in set(la)) + sum(n for _, n in set(lb)))


def hashed(text):
    """Spark's xxhash64 of a text."""
    h = xxhash.xxh64_intdigest(text, 42)
    return h - (h >> 63 << 64), text


def expected(rows, tie=str):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, tie(r[1] or "")))
    out = []
    for i, (key, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), tree(text)[0], tree(edited)[0], likeness(text, edited), likeness(text, after)))
    return out


def same(got, want):
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    return [(g, w) for g, w in zip(got, want, strict=True)]


def test_query_matches_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    pairs = same(merkle.op4_fingerprints(spark, "/root/testdata/sf0.01").collect(), expected([(d.doc_id, d.text) for d in docs]))
    # sections that hold the same leaves in another order are rare, and so is a difference here
    assert sum(abs(g[5] - w[5]) < 1e-9 and abs(g[6] - w[6]) < 1e-9 for g, w in pairs) >= 0.97 * len(pairs)
    assert all(abs(g[5] - w[5]) < 0.2 and abs(g[6] - w[6]) < 0.2 for g, w in pairs)
    near = sorted(g[5] for g, _ in pairs)
    assert 0.3 < near[len(near) // 2] < 0.7


def test_edge_cases(spark):
    rows = [(5, None), (7, ""), (7, "A b. C d.\n\nE f!"), (7, "A b. C d.\n\nE f!"), (None, "é" * 1001), (9, "x. " * 30_000)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, fingerprint string")
    same(merkle.fingerprints_with_edit(docs).collect(), expected(rows, hashed))
    assert merkle.fingerprints_with_edit(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    same(merkle.fingerprints_with_edit(one).collect(), expected([(1, "abcd")]))


def test_keys_that_many_rows_share(spark):
    rows = [(None, f"null {i}") for i in range(400)] + [(50, f"fifty {i % 200}") for i in range(400)] + [(i, f"own {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(merkle.fingerprints_with_edit(docs).collect(), expected(rows, hashed))
    dealt, _ = merkle.by_ranges(docs.selectExpr("doc_id as key", "text"), "key", "text")
    assert dealt.groupBy("_range").count().agg({"count": "max"}).first()[0] < 60


def test_edits_are_located(spark):
    a = "One two. Three four.\nFive six. Seven.\n"
    b = "One two. Three four.\nFive 66. Seven.\n"
    df = spark.createDataFrame([(1, a, b)], "doc_id long, a string, b string")
    df = merkle.with_fingerprint(merkle.with_fingerprint(df, "a", "x"), "b", "y")
    assert [tuple(r) for r in merkle.locate_edits(df, "doc_id", "x", "y").collect()] == [(1, 21, 9)]

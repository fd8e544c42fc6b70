import hashlib

from deploy_analytics.llm import exact_dedup as ed

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """(key, keep_id, group_size, sha) of each row, and how many rows stay for each text."""
    groups = {}
    for key, text in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(key)
    best = {t: max((k for k in keys if k is not None), default=None) for t, keys in groups.items()}
    return sorted(((k, best[n], len(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for k, n in ((k, (t or "").translate(LOWER)) for k, t in rows)), key=str), len(groups)


def check(spark, rows, **how):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, level string, sha int")
    found = ed.exact_dedup(docs, **how).collect()
    want, groups = brute(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == want
    assert sum(r.kept for r in found) == groups
    assert all(r.doc_id == r.keep_id for r in found if r.kept)
    left = ed.drop_copies(docs)
    assert left.columns == docs.columns and left.count() == groups


def test_edge_cases(spark):
    long = "Abc é漢\U0001f600 " * 700
    check(spark, [(1, None), (2, ""), (None, ""), (3, "x"), (3, "X"), (3, "x"), (None, "y"), (None, "Y"), (4, "É"), (5, "é"), (6, long), (7, long.upper().replace("É", "é")), (8, long + "x"), (9, "\n"), (10, " ")])
    assert ed.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert ed.drop_copies(spark.createDataFrame([], "doc_id long, text string, _sha string")).count() == 0


def test_ragged_tails_and_every_block_count(spark):
    rows = [(i, "ab" * 50 + "c" * (i // 2)) for i in range(80)] + [(100 + i, "q" * i) for i in range(40)]
    check(spark, rows, block_chars=7)
    check(spark, rows, block_chars=1)


def test_clashing_columns_survive(spark):
    docs = spark.createDataFrame([(1, "a", "own", 7), (2, "A", "other", 8)], "doc_id long, text string, _sha string, _key int")
    assert [tuple(r) for r in ed.drop_copies(docs).collect()] == [(2, "A", "other", 8)]

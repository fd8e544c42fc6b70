import math
import os
import re
from collections import Counter

from deploy_analytics.llm import license_scan as ls


def terms_of(text):
    return re.findall("[a-z0-9]+", text.lower())


def license_texts():
    """Read here, not by the operator: short ones as stated there, long ones from their files."""
    folder = os.path.join(os.path.dirname(ls.__file__), "license_texts")
    return ls.SHORT_TEXTS | {name.removesuffix(".txt"): open(os.path.join(folder, name)).read() for name in sorted(os.listdir(folder))}


def brute(rows):
    """(key, license, origin, from_directory) from (key, path, text), unit by unit and directory by directory, without any candidate filter."""
    total = len(rows)
    seen = Counter(t for _, _, text in rows for t in set(terms_of(text or "")))
    whole_texts = license_texts()
    vocabulary = {t for all_ in [*ls.TEMPLATES.values(), whole_texts.values()] for s in all_ for t in terms_of(s)}
    idf = lambda t: math.log((total + 1) / ((seen[t] if t in vocabulary else 0) + 1)) + 1
    vector = lambda terms, whole: {t: (1 if whole else n) * idf(t) for t, n in Counter(terms).items()}
    templates = [(name, vector(terms_of(s), False)) for name, all_ in ls.TEMPLATES.items() for s in all_]
    texts = [(name, vector(terms_of(s), True)) for name, s in whole_texts.items()]

    def cosine(a, b):
        dot = sum(w * b.get(t, 0) for t, w in a.items())
        return round(dot / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values())), 9) if dot else 0.0

    own, speaking = {}, {}
    for i, (_, path, text) in enumerate(rows):
        best, chars = None, 0
        for known, first, unit, whole in [(templates, 0, u, False) for u in re.split(ls.UNITS, text or "")] + [(texts, len(templates), text or "", True)]:
            v = vector(terms_of(unit), whole)
            found = max(((whole, cosine(v, t), -k, name) for k, (name, t) in enumerate(known, first)), default=None) if v else None
            if found and found[1] >= ls.LEAST:
                best, chars = max(best or found, found), chars + len(unit)
        own[i] = best
        if best and path is not None and chars >= ls.FILE_SHARE * len(text):
            speaking.setdefault(path.rpartition("/")[0], []).append((-best[1], best[3]))
    out = []
    for i, (key, path, _) in enumerate(rows):
        if own[i]:
            out.append((key, own[i][3], "own", None))
            continue
        at = None if path is None else path.rpartition("/")[0]
        while at is not None and at not in speaking:
            at = at.rpartition("/")[0] if at else None
        out.append((key, min(speaking[at])[1] if at is not None else None, "none" if at is None else "inherited", at))
    return out


def got(df):
    return sorted(((r.doc_id, r.license, r.origin, r.from_directory) for r in df.collect()), key=str)


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    rows = [(d.doc_id, f"{d.source}/{d.doc_id // 1000}/{d.doc_id // 100 % 10}/{d.doc_id}", d.text) for d in docs]
    want = sorted(brute(rows), key=str)
    assert got(ls.op5_license_scan(spark, "/root/testdata/sf0.01")) == want
    assert {r[0] for r in want if r[2] == "own"} == {d.doc_id for d in docs if re.search(r"(?m)(^|[.!?] )(Licensed under (the Apache|CC)|Released under the MIT|This work is licensed)", d.text)}


def test_inheritance_and_edge_cases(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, "a/LICENSE", mit), (2, "a/b/c/x", "some words"), (3, "a/b/y", f"code\n{apache}\nmore code that is long enough not to be a licence file"), (4, "a/b/z", None), (5, "q/r", ""),
        (6, None, "nothing"), (None, "a/d/LICENSE", apache), (8, "a/d/e/f", "other words"), (9, "top", "mit license of words " * 3000), (2, "a/b/c/x", "some words"),
    ]
    rows += [(100 + i, f"w/{i}", f"filler text number {i}") for i in range(100)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, path string, text string, license int")
    result = got(ls.license_scan(docs))
    assert result == sorted(brute(rows), key=str)
    by = {r[0]: r[1:] for r in result}
    assert by[2] == ("MIT", "inherited", "a") and by[3] == ("Apache-2.0", "own", None) and by[8] == ("Apache-2.0", "inherited", "a/d") and by[5] == (None, "none", None)
    assert ls.license_scan(docs.limit(0)).count() == 0


def test_common_headers_and_small_tables(spark):
    mit = "Released under the MIT License."
    rows = [(i, f"a/{i}/x", f"{mit}\nsome text number {i} that is much longer than the header" if i % 2 else f"plain words {i}") for i in range(60)]
    for part in (rows, rows[1:2], [(1, "a/LICENSE", mit), (2, "a/b/c", "words")]):
        result = got(ls.license_scan(spark.createDataFrame(part, "doc_id long, path string, text string")))
        assert result == sorted(brute(part), key=str)
        assert {r[0] for r in result if r[1:3] == ("MIT", "own")} == {k for k, _, text in part if mit in text}


def test_whole_license_files(spark):
    filler = lambda i: f"plain words number {i} about nothing"
    mit = "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + ls.TEXTS["MIT"]
    rows = [(1, "p/LICENSE", mit), (2, "p/src/a", filler(2)), (3, "q/COPYING", ls.TEXTS["BSD-3-Clause"].lower().replace("\n", " ")), (4, "q/x/y/z", filler(4)), (5, "r/a", filler(5)), (6, "s/LICENSE", ls.TEXTS["ISC"])]
    for more in (0, 40):
        table = [*rows, *((100 + i, f"t/{i}", filler(i)) for i in range(more))]
        result = got(ls.license_scan(spark.createDataFrame(table, "doc_id long, path string, text string")))
        assert result == sorted(brute(table), key=str)
        by = {r[0]: r[1:] for r in result}
        assert by[1] == ("MIT", "own", None) and by[2] == ("MIT", "inherited", "p") and by[4] == ("BSD-3-Clause", "inherited", "q") and by[5][0] is None and by[6][:2] == ("ISC", "own")


def test_long_license_files_name_themselves_whatever_the_other_rows(spark):
    texts = license_texts()
    names = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "BSD-3-Clause", "MIT"]
    rows = [(10 * i + k, f"p{i}/{('LICENSE', 'src/a')[k]}", (texts[n], f"plain words number {i} about nothing")[k]) for i, n in enumerate(names) for k in (0, 1)]
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "concat('docs/', source, '/', doc_id) as path", "text")
    alone = spark.createDataFrame(rows, "doc_id long, path string, text string")
    for table in (alone, alone.unionByName(corpus)):
        by = {r.doc_id: (r.license, r.origin) for r in ls.license_scan(table).collect()}
        for i, name in enumerate(names):
            assert by[10 * i] == (name, "own") and by[10 * i + 1] == (name, "inherited")
    assert got(ls.license_scan(alone)) == sorted(brute(rows), key=str)

import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from deploy_analytics.llm import variants as va


def plain(words: dict[str, int], ratio: int = 10) -> set:
    """The contract, word by word: all neighbours from wildcards and deletions, then forms, then roots."""
    near, wild = defaultdict(set), defaultdict(list)
    for w in words:
        for i in range(len(w)):
            wild[w[:i], w[i + 1 :]].append(w)
            shorter = w[:i] + w[i + 1 :]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in wild.values():
        for a in group:
            near[a].update(b for b in group if b != a)
    form = {}
    for w in words:
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= ratio * words[w]:
                form[w] = best

    def root(w):
        while w in form and ratio > 1:  # else there may be circles
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def runs(docs) -> dict[str, int]:
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def test_query_matches_plain_neighbours(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in va.op11_spelling_variants(spark, "/root/testdata/sf0.01").collect()]
    want = plain(runs(docs))
    assert len(got) == len(want) > 10_000 and set(got) == want
    assert sum(r[1] is not None for r in got) > 100


WORDS = st.dictionaries(st.text("abñ", min_size=1, max_size=7), st.integers(1, 2000), max_size=25)


@settings(max_examples=25, deadline=None)
@given(WORDS)
def test_scan_of_any_words(words):
    names = sorted(words)
    entries = sorted((key, kind, i) for i, w in enumerate(names) for key, kind in va.rotations(w))
    import pyarrow as pa

    batches = [
        pa.RecordBatch.from_arrays([pa.array([e[0] for e in part], pa.binary()), pa.array([e[1] for e in part], pa.int8()), pa.array([e[2] for e in part], pa.int64()), pa.array([words[names[e[2]]] for e in part], pa.int64())], ["key", "kind", "id", "n"])
        for part in (entries[i : i + 7] for i in range(0, len(entries), 7))
    ]
    near, best = Counter(), {}
    for batch in va.scan(batches):
        for i, k, n, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            near[i] += k
            best[i] = min(best.get(i, (0, 0)), (-n, other))
    want = plain(words, ratio=0)
    assert {(w, names[best[i][1]] if i in best else None, near[i]) for i, w in enumerate(names)} == {(w, form, count) for w, form, _, _, count, _ in want} if words else not near


def test_roots_follow_forms_to_the_last(spark):
    words = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "aaabbbb": 20_000, "aabbbbb": 200_000, "zzzzzzz": 5}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {tuple(r) for r in va.variants(df).collect()}
    assert got == plain(words)
    assert next(r for r in got if r[0] == "aaaaaaa")[2] == "aabbbbb"


def test_long_words_cost_their_length(spark):
    long = "ab" * 20_000
    words = {long: 2, long[:-1]: 40, long[:-1] + "c": 3, "ñ" + long[1:]: 30, "x" * va.TEXT_KEY: 2, "x" * (va.TEXT_KEY + 1): 50, "x" * (va.TEXT_KEY - 1): 2}
    got = {r.word: r for r in va.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert {w: r.n_near for w, r in got.items()} == {long: 3, long[:-1]: 2, long[:-1] + "c": 2, "ñ" + long[1:]: 1, "x" * va.TEXT_KEY: 2, "x" * (va.TEXT_KEY + 1): 1, "x" * (va.TEXT_KEY - 1): 1}
    assert got[long].form == long[:-1] and got["x" * va.TEXT_KEY].form == "x" * (va.TEXT_KEY + 1)


def test_numbers_agree_with_text(monkeypatch):
    words = ("abcabca", "aabbbac", "aabbac", "ababab", "ab", "ññéñ")
    text = [[e for e in va.rotations(w)] for w in words]
    monkeypatch.setattr(va, "TEXT_KEY", 0)
    numbers = [[e for e in va.rotations(w)] for w in words]
    same = {(a, b) for x, y in zip(text, numbers, strict=True) for (a, _), (b, _) in zip(x, y, strict=True)}
    assert len({a for a, _ in same}) == len({b for _, b in same}) == len(same)
    assert [[k for _, k in x] for x in text] == [[k for _, k in x] for x in numbers]


def test_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, "Straßen straßen", "z"), (3, "Überall ÜBERALL überall überalle", "w"), (3, "Überall ÜBERALL überall überalle", "w"), (4, "ab " * 50_000 + "q" * 100_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    got = {r.word: r.n for r in va.word_counts(docs).collect()}
    assert got == {"straßen": 2, "Überall": 4, "überall": 2, "überalle": 2}  # only A-Z are lower-cased: Ü stays
    shown = {tuple(r) for r in va.variants(va.word_counts(docs)).collect()}
    assert shown == plain(got)
    empty = docs.limit(0)
    assert va.variants(va.word_counts(empty)).collect() == []
    assert va.variants(va.word_counts(docs)).columns == ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.parametrize("key", [7, "7"])
def test_a_run_is_changed_with_its_document(spark, key):
    run = next(w for w in (f"abcdef{a}{b}" for a in "abcdefghij" for b in "abcdefghij") if zlib.crc32(f"7:{w}".encode()) % 31 == 0)
    docs = spark.createDataFrame([(key, f"{run} {run}")], f"doc_id {'long' if key == 7 else 'string'}, text string")
    i = zlib.crc32(f"7:{run}".encode()) % len(run)
    assert [tuple(r) for r in va.word_counts(docs, change=va._thinned).collect()] == [(run[:i] + run[i + 1 :], 2)]

import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import public_tokenizers
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from deploy_analytics.llm import packing, tokens


@lru_cache
def plain_tokenizer(path):
    return Tokenizer.from_file(path)


def check(rows, capacity=2048):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_query_against_plain_tokenizing(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    rows = packing.op1_best_fit_packing(spark, "/root/testdata/sf0.01").collect()
    want = {}
    for d in docs:
        ids = [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 0]
        for p in range(0, len(ids), 2048):
            part = ids[p : p + 2048]
            want[d.doc_id, p // 2048] = (p, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    assert len(rows) == len(want)
    total = sum(v[1] for v in want.values())
    assert check(rows) <= -(-total // 2048) + 1


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([*"abcÉéßÀñİſ19 .,'!?-#$\n\t\u0301\u00a0", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|"]), st.characters(codec="utf-8")), max_size=30).map("".join))
@example("İ:")
@example("aİ.İ-b")
def test_word_ids_of_any_text(text):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = plain_tokenizer(path)
    assert tokens.word_ids([text], tokens.word_memo(path)) == [tokens.ids_bytes(plain.encode(text, add_special_tokens=False).ids)]


def test_memo_forgets_and_still_answers():
    memo = tokens.Memo(lambda parts: [p * 4 for p in parts], cap=3)
    for part in (b"a", b"b", b"c", b"d", b"a", b"e", b"f", b"g", b"a"):
        assert memo[part] == part * 4
    assert len(memo) <= 3


def test_fullest_matches_brute_force():
    random.seed(5)
    for _ in range(200):
        counts = Counter(random.choices(range(1, 30), k=random.randrange(1, 9)))
        room = random.randrange(0, 60)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * m for s in sums for m in range(n + 1) if s + k * m <= room}
        used = packing.fullest(dict(counts), room)
        assert sum(k * n for k, n in used.items()) == max(sums)
        assert all(n <= counts[k] for k, n in used.items())


def test_plan_uses_every_piece_once():
    random.seed(6)
    histogram = Counter(random.choices(range(1, 101), k=5000)) + Counter({100: 3000, 7: 2000})
    used = Counter()
    for p in packing.plan(histogram, 100):
        assert sum(k * n for k, n in p.parts) <= 100
        for k, n in p.parts:
            used[k] += n * p.times
    assert used == histogram


def test_edge_cases(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(1, None, 9), (2, "", 9), (None, "one two", 9), (4, "word " * 5000, 9), (4, "word " * 5000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    pieces = packing.token_pieces(docs, path)
    packed = packing.pack(pieces).collect()
    assert check(packed) == 5
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in packed) == sorted(
        [(1, 0, 1), (2, 0, 1), (0, 0, 3)] + 2 * [(4, 0, 2048), (4, 1, 2048), (4, 2, 905)]
    )
    assert all(len(r.ids) == r.length for r in packed)
    assert packing.pack(packing.token_pieces(docs.limit(0), path)).count() == 0
    clash = spark.createDataFrame([(5, 1, 2)], "length long, offset int, sequence_id int")
    assert [tuple(r) for r in packing.pack(clash).collect()] == [(5, 0, 0)]

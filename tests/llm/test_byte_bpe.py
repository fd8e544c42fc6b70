import hashlib
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from deploy_analytics.llm import byte_bpe, tokens

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=tokens.read_ranks(PATH), special_tokens={})


def test_query_matches_library(spark, plain):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = byte_bpe.op3_byte_bpe(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aab  \n'st=-é漢🙂"), st.characters(codec="utf-8")), max_size=40))
def test_any_text_round_trips(plain, text):
    c = byte_bpe.codec(PATH, PATTERN)
    ids = [int(i) for i in struct.unpack(f"<{len(c.encode(text)) // 4}I", c.encode(text))]
    assert ids == plain.encode_ordinary(text)
    assert c.decode(ids).decode() == text
    assert "".join(c.pieces(ids)) == text
    starts, ends = c.offsets(ids, text)
    assert all(c.bytes_of[i].decode("utf-8", "ignore") in text[a:b] for i, a, b in zip(ids, starts, ends, strict=True))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aabn tis=- \n漢é"), min_size=1, max_size=60), st.integers(1, 8))
def test_rank_order_of_repeating_matches(plain, text, times):
    c, part = byte_bpe.codec(PATH, PATTERN), text * times
    assert byte_bpe.by_rank(part.encode(), c.ranks) == plain._encode_single_piece(part)


def test_long_matches(plain):
    c = byte_bpe.codec(PATH, PATTERN)
    for text in ("=" * 50_000, "ab" * 40_000, " " * 30_000 + "x", "漢字" * 20_000):
        ids = c.encode(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == plain.encode_ordinary(text)


def test_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, "naïve 🙂", "z"), (4, "ab " * 100_000, None), (4, "ab " * 100_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    both = byte_bpe.encode(docs, PATH, PATTERN, offsets=True)
    back = byte_bpe.decode(byte_bpe.decode(both, PATH, PATTERN), PATH, PATTERN, per_token=True).collect()
    assert [bytes(r.decoded).decode() for r in back] == [r[1] or "" for r in rows]
    assert ["".join(r.pieces) for r in back] == [r[1] or "" for r in rows]
    assert back[2].ends[-1] == len(rows[2][1])
    assert byte_bpe.encode(docs.limit(0), PATH, PATTERN).count() == 0

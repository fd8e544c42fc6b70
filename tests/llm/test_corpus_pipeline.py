import re
import sys
from pathlib import Path

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from deploy_analytics.llm import toxicity

sys.path.insert(0, str(Path(__file__).parent))
from test_near_dedup import brute
from test_packing import check
from test_secret_scan import base

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_stages_match_plain_versions(spark):
    sf = "/root/testdata/sf0.01"
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert name == "best_fit_packing" or out.columns == columns
        rows = [r.asDict() for r in out.collect()]
        seen.append(rows)
        docs = spark.createDataFrame(rows, out.schema)
    start = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    clean, exact, near, masked, packed = seen

    predicted = {r.doc_id: r.predicted for r in toxicity.op8_toxicity(spark, sf).collect()}
    assert {r["doc_id"] for r in clean} == {k for k, p in predicted.items() if not p} and len(clean) < len(start)

    last = {}
    for r in clean:
        text = r["text"].translate(LOWER)
        last[text] = max(last.get(text, -1), r["doc_id"])
    assert {r["doc_id"] for r in exact} == set(last.values())

    groups = brute([(r["doc_id"], r["text"]) for r in exact])
    assert {r["doc_id"] for r in near} == {min(g) for g in groups}

    before = {r["doc_id"]: r["text"] for r in near}
    assert before.keys() == {r["doc_id"] for r in masked}
    for r in masked:
        if base(before[r["doc_id"]]):
            assert "[secret]" in r["text"] and r["n_chars"] == len(r["text"])
        elif "[secret]" not in r["text"]:
            assert r["text"] == before[r["doc_id"]]

    class Row:
        def __init__(self, d):
            self.__dict__ = d

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = sum(len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in masked)
    assert sum(r["length"] for r in packed) == total
    assert check([Row(r) for r in packed]) <= -(-total // 2048) + 1
    assert re.fullmatch("doc_id,piece,start,length,ids_crc32,sequence_id,offset", ",".join(packed[0]))


def test_nulls_repeats_and_empty_tables(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(3000))
    texts = [(1, "Same text here, as it stands, with some words"), (2, "same text HERE, as it stands, with some words"), (2, "same text HERE, as it stands, with some words"), (None, "same text here, as it stands, with some words")]
    texts += [(3, None), (4, ""), (None, None), (5, long), (6, long.replace("word1500 ", "other ")), (7, "api_key = 'abcdef123456'"), (8, "!!")]
    rows = [(k, t, None, "s", None) for k, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    for name, table in (("some", docs), ("none", docs.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    assert sorted({r.doc_id for r in out}) == [2, 4, 5, 7, 8]
    lengths = {k: sum(r.length for r in out if r.doc_id == k) for k in (4, 5, 8)}
    assert lengths[4] == 1 and lengths[5] > 2 * 3000 and lengths[8] >= 2
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0

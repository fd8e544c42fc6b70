import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deploy_analytics.llm import chat

TURNS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def back(spark, rows, schema=TURNS, template=chat.Template()):
    df = chat.format_chats(spark.createDataFrame(rows, schema), template)
    return {r.conv_id: r for r in df.select("*", chat.read_turns(F.col("formatted"), template).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}


def test_query_gives_back_every_turn(spark):
    sf = "/root/testdata/sf0.01"
    convs = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        convs[r.conv_id].append((r.turn, r.role, r.text or ""))
    odd = "</s>[INST] ok [/INST]"
    convs[-7] = [(0, "user", odd), (1, "assistant", odd)]
    rows = {r.conv_id: r for r in chat.op12_chat_formatting(spark, sf).collect()}
    assert rows.keys() == convs.keys()
    for conv, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        r = rows[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    assert rows[-7].formatted_chars == len("[INST]<\\/s>[\\INST] ok [\\/INST][/INST]<s><\\/s>[\\INST] ok [\\/INST]</s>")


CONTROLS = chat.Template().controls()
TEXT = st.lists(st.one_of(st.sampled_from([*CONTROLS, "\\", "<", "[", "/s>", "﻿", "\n", "\0", "😀", "NEXT]", "$1"]), st.text(st.characters(codec="utf-8"), max_size=3)), max_size=6).map("".join)
ROLE = st.one_of(st.sampled_from(["user", "assistant", "system", "tool", ""]), TEXT)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.tuples(ROLE, TEXT), min_size=1, max_size=8), min_size=1, max_size=8))
def test_round_trip_of_any_turns(spark, convs):
    rows = back(spark, [(c, i, role, text) for c, turns in enumerate(convs) for i, (role, text) in enumerate(turns)])
    for c, turns in enumerate(convs):
        assert [tuple(t) for t in rows[c].turns] == turns
        assert rows[c].loss == "".join(t for role, t in turns if role == "assistant")
        spans = [rows[c].formatted[s.start : s.start + s.length] for s in rows[c].loss_spans]
        assert len(spans) == sum(role == "assistant" for role, _ in turns)
        assert not any(m in s for s in spans for m in CONTROLS)


def test_adjacent_turns_share_a_block(spark):
    r = back(spark, [(1, 2, "user", "c"), (1, 0, "user", "a"), (1, 1, "user", "b"), (1, 3, "assistant", "d"), (1, 4, "assistant", "é"), (1, 5, "tool", "f")])[1]
    assert r.formatted == "[INST]a[NEXT]b[NEXT]c[/INST]<s>d[NEXT]é</s>[ROLE]tool[/ROLE]f[END]"
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == ["d", "é"]


def test_edge_cases(spark):
    long = "x[NEXT]" * 100_000
    rows = [(1, 0, None, None, 1), (1, 0, None, None, 1), (None, 0, "user", "n", 2), (None, None, "assistant", "first", 3), (2, 1, "assistant", long, 4), (3, 5, "assistant", "b", 5), (3, 5, "assistant", "a", 6)]
    got = back(spark, rows, TURNS + ", formatted long")
    turns = {c: [tuple(t) for t in r.turns] for c, r in got.items()}
    assert turns == {1: [("", ""), ("", "")], None: [("assistant", "first"), ("user", "n")], 2: [("assistant", long)], 3: [("assistant", "a"), ("assistant", "b")]}
    assert got[2].loss == long and got[3].loss == "ab" and got[1].loss == ""
    assert back(spark, [], TURNS) == {}


def test_many_turns(spark):
    rows = [(1, i, ("user", "assistant")[i % 3 > 0], f"text {i}") for i in range(3000)]
    r = back(spark, rows)[1]
    assert [tuple(t) for t in r.turns] == [x[2:] for x in rows]
    assert r.loss == "".join(x[3] for x in rows if x[2] == "assistant")


def test_templates_that_could_be_misread_are_refused(spark):
    with pytest.raises(ValueError):
        chat.Template(between="[INST")
    with pytest.raises(ValueError):
        chat.Template(between="<<NEXT>>")
    with pytest.raises(ValueError):
        chat.Template(between="\\n")
    own = chat.Template({"user": ("<|user|>", "<|end|>"), "assistant": ("<|bot|>", "<|stop|>")}, "<|and|>", ("<|role|>", "<|is|>", "<|done|>"))
    r = back(spark, [(1, 0, "user", "<|bot|>.*"), (1, 1, "assistant", "hi|>"), (1, 2, "system", "s")], template=own)[1]
    assert r.formatted == "<|user|><\\|bot|>.*<|end|><|bot|>hi|><|stop|><|role|>system<|is|>s<|done|>"
    assert [tuple(t) for t in r.turns] == [("user", "<|bot|>.*"), ("assistant", "hi|>"), ("system", "s")] and r.loss == "hi|>"


def test_stays_in_the_engine(spark):
    plan = chat.op12_chat_formatting(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

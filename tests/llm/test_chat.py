"""Folding of events, the reversible template, and the digests."""

import hashlib

from hypothesis import given
from hypothesis import strategies as st

from sparrowdoc.llm import q02_chat
from sparrowdoc.llm.chat import MESSAGE, conversations, digests, escape, folded, format_events, messages_as_events, render, unescape

EVENTS = "conv_id long, turn long, seq long, kind string, role string, text string"


@given(st.text(alphabet="<|>\\n\nim_startend assistant é😀"), st.sampled_from(["user", "assistant", "a\n<|b\\"]))
def test_round_trip(text, role):
    piece, a, b = render(role, text)
    found = MESSAGE.fullmatch(piece)
    assert unescape(found["text"]) == text and unescape(found["role"]) == role
    assert "<|" not in escape(text)
    assert unescape(piece[a:b]) == (text if role == "assistant" else "")


def test_fold():
    log = [
        (1, 0, 0, "message", "user", "hi"),
        (1, 0, 9, "edit", "user", "hello"),
        (1, 1, 1, "message", "assistant", ""),
        (1, 1, 2, "delta", "assistant", "a"),
        (1, 1, 3, "delta", "assistant", "b"),
        (1, 1, 6, "regenerate", "assistant", None),
        (1, 1, 7, "delta", "assistant", "c"),
        (1, 2, 4, "message", "user", "withdrawn"),
        (1, 2, 8, "message", "user", "kept"),
        (2, 2, 4, "delta", "assistant", "other log"),
    ]
    assert list(folded(log)) == [(1, "user", "hello"), (1, "assistant", "c"), (1, "user", "kept"), (2, "assistant", "other log")]


def test_odd_rows(spark):
    rows = [(1, 0, 0, "message", None, None), (1, 1, 1, "message", "assistant", "x" * 300_000), (1, 1, 1, "message", "assistant", "x" * 300_000), (None, None, None, "message", "assistant", "😀<|")]
    log = spark.createDataFrame([(*r, 1) for r in rows], EVENTS + ", piece int")
    got = {r.conv_id: r for r in digests(format_events(log)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 600_000
    assert got[None].loss_chars == 3 and got[None].loss_sha256 == hashlib.sha256("😀<|".encode()).hexdigest()
    whole = {r.conv_id: r for r in conversations(format_events(log)).collect()}
    assert [len(whole[1].formatted), len(whole[None].formatted)] == [got[1].formatted_chars, got[None].formatted_chars]
    assert unescape("".join(whole[None].formatted[s.a : s.b] for s in whole[None].loss_spans)) == "😀<|"
    assert format_events(log.where("false")).count() == 0


def test_deltas_give_the_same_messages(spark, sf):
    messages = spark.read.parquet(f"{sf}/conversations.parquet")
    whole = digests(format_events(messages_as_events(messages)))
    cut = messages.selectExpr(
        "conv_id", "turn", "posexplode(array('message', 'delta', 'delta')) as (i, kind)", "role", "text"
    ).selectExpr("conv_id", "turn", "turn * 10 + i as seq", "kind", "role", "case i when 0 then substr(text, 1, 3) when 1 then substr(text, 4, 20) else substr(text, 24) end as text")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, digests(format_events(cut)).collect()))


def test_query(spark, sf):
    assert q02_chat.query(spark, sf).where("conv_id = -1").first().loss_chars == len(q02_chat.TRICKY)

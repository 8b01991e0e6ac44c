"""Encoding against tiktoken and the tokenizers library, decoding, and packing."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparrowdoc.llm import packing
from sparrowdoc.llm.byte_bpe import decode, encode, round_trips
from sparrowdoc.llm.tokens import Bare, Encoder, Spaced, byte_bpe, byte_values, read_ranks

RANKS, PATTERN, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, n_tokens int, start string"
TEXTS = st.text(alphabet=st.one_of(st.sampled_from(" \n\t\x0b\x85  'sdABx1é\u0301Σσß,..,<|endoftext|>\0"), st.characters(codec="utf-8")), max_size=60)


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def ours():
    return Encoder(byte_bpe(RANKS, PATTERN), Spaced)


@pytest.fixture(scope="module")
def whole():
    out = Tokenizer.from_file(WORDS)
    out.encode_special_tokens = True
    return out


@pytest.fixture(scope="module")
def parted():
    with open(WORDS) as f:
        return Encoder(f.read(), Bare, memory=50)


@pytest.fixture(scope="module")
def values(ours):
    return byte_values(ours.tokenizer)


@settings(max_examples=1500, deadline=None)
@given(TEXTS)
def test_bytes_as_tiktoken(theirs, ours, values, text):
    ids = np.frombuffer(ours.ids(text), "<u4").tolist()
    assert ids == theirs.encode_ordinary(text)
    assert b"".join(values[i] for i in ids) == text.encode()


@settings(max_examples=1500, deadline=None)
@given(TEXTS)
def test_words_as_whole(parted, whole, text):
    assert np.frombuffer(parted.ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_documents(spark, sf, theirs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = set()
    for r in docs.collect():
        ids = theirs.encode_ordinary(r.text)
        want.add((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    assert {tuple(r) for r in round_trips(docs, RANKS, PATTERN).collect()} == want


def test_odd_rows(spark):
    texts = [None, "", "  a  \n b", "x" * 30_000, "😀é " * 20_000, "<|endoftext|>", "a", "a"]
    docs = spark.createDataFrame([(i if i != 6 else None, t, 1, "c") for i, t in enumerate(texts)], DOCS)
    rows = {r.doc_id: r for r in encode(docs, RANKS, PATTERN).collect()}
    for i, t in enumerate(texts):
        r = rows[i if i != 6 else None]
        assert all(a <= b for a, b in zip(r.starts, r.ends)) and (not r.ids or r.ends[-1] == len(t))
    back = {r.doc_id: r for r in decode(encode(docs, RANKS, PATTERN), RANKS, PATTERN).collect()}
    assert all(back[i if i != 6 else None].text == (t or "") for i, t in enumerate(texts))
    cut = spark.createDataFrame([(1, rows[4].ids[:1]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in decode(cut, RANKS, PATTERN).collect()}[2] is None
    assert round_trips(docs.where("false"), RANKS, PATTERN).count() == 0 and len(round_trips(docs, RANKS, PATTERN).collect()) == 8


def valid(rows, tokens, size=4096):
    """Every id once, no gaps in sequences, checksums; returns the share of padding."""
    docs, sequences = {}, {}
    for doc, start, length, crc, total, sequence, at in rows:
        assert length > 0 and total == len(tokens[doc]) and crc == zlib.crc32(tokens[doc][start : start + length].tobytes())
        docs.setdefault(doc, []).append((start, length))
        sequences.setdefault(sequence, []).append((at, length))
    assert docs.keys() == tokens.keys()
    for doc, spans in docs.items():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == len(tokens[doc])
    filled = 0
    for spans in sequences.values():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at <= size
        filled += at
    return 1 - filled / (size * len(sequences))


def test_packing_documents(spark, whole):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    tokens = {r.doc_id: np.array(whole.encode(r.text, add_special_tokens=False).ids + [2], "<u4") for r in docs.collect()}
    for parts in (1, 7):
        rows = [tuple(r) for r in packing.pack(docs.repartition(parts), WORDS).collect()]
        assert valid(rows, tokens) < 0.02


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(1, 4), st.integers(1, 8))
def test_windows(lengths, most, gap):
    tokens = {i: np.arange(n, dtype="<u4") + i for i, n in enumerate(lengths)}
    windows = packing.Windows(0, 16, most, gap)
    rows = [r for i, t in tokens.items() for r in windows.add(i, t.tobytes())]
    assert len(windows.open) <= most
    rows += packing.merge([p for _, pieces in windows.open for p in pieces], 1 << 40, 16)
    if lengths:
        valid(rows, tokens, 16)


def test_packing_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1, "c"), (2, "", 1, "c"), (None, "a b", 1, "c"), (4, "a b " * 9000, 1, "c"), (5, "x", 1, "c")], DOCS)
    rows = packing.pack(docs, WORDS).collect()
    assert {r.doc_id for r in rows} == {1, 2, None, 4, 5} and sum(r.length for r in rows) == 1 + 1 + 3 + 18001 + 2
    assert packing.pack(docs.where("false"), WORDS).count() == 0


def test_a_small_memory_changes_no_ids():
    from sparrowdoc.llm.tokens import Bare, Encoder

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        serialised = f.read()
    texts = [f"Word{i} again, and again.\nÉtude {i % 7} <x> " + "long " * (i % 5) for i in range(60)] + ["", " "]
    small, large = Encoder(serialised, Bare, 10), Encoder(serialised, Bare)
    assert [x for at in range(0, len(texts), 4) for x in small.batch(texts[at : at + 4])] == large.batch(texts)

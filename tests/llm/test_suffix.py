"""Repeated passages against all 400-byte strings."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from sparrowdoc.llm.suffix import SHORT, WORDS, Family, Index, find_repeats, repeats, sliding_min, without_repeats

DOCS = "doc_id long, text string, n_bytes string, k int"


def covered(raw, length):
    """For each text, which bytes a repeated string of that length covers."""
    seen = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - length + 1):
            if seen[x[p : p + length]] > 1:
                gone[p : p + length] = True
        out.append(gone)
    return out


def brute(rows, length=400):
    raw = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), x, gone, short in zip(rows, raw, covered(raw, length), covered(raw, SHORT)):
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(x) else 0
        kept = bytes(np.frombuffer(x, np.uint8)[~gone]) if len(x) else b""
        passages, at = 0, 0
        while at < len(x):
            to = at
            while to < len(x) and short[to]:
                to += 1
            inside = [m for m in re.finditer(rb"[^ \t-\r]+", x) if m.start() >= at and m.end() <= to] if to > at else []
            passages += len(inside) > WORDS
            at = max(to, at + 1)
        out.append((i, len(x), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), passages))
    return sorted(out, key=str)


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghé"), rng.integers(2, 7))) for _ in range(n))


def made(seed=0):
    rng = np.random.default_rng(seed)
    passage, long = words(rng, 110), words(rng, 400)
    rows = [(i, f"{words(rng, int(rng.integers(5, 60)))} {passage} {words(rng, int(rng.integers(5, 60)))}") for i in range(40)]
    rows += [(100 + i, long[int(a) : int(a) + int(n)]) for i, (a, n) in enumerate(zip(rng.integers(0, 900, 25), rng.integers(200, 1500, 25)))]
    rows += [(200 + i, words(rng, 120)) for i in range(20)]
    rows += [(300, "ab" * 700), (301, "x" * 1000), (302, "x" * 401), (303, "y" * 400), (304, "y" * 399), (305, None), (306, ""), (None, long), (308, passage + passage), (308, passage + passage)]
    near = long.split()
    for i in range(15):
        own = list(near)
        own[int(rng.integers(0, 400))] = "edit"
        rows.append((400 + i, " ".join(own)))
    return rows


@pytest.mark.parametrize("most, batches", [(100_000, 3), (3, 2), (100_000, 1)])
def test_made(spark, most, batches):
    rows = made()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS).repartition(5)
    assert sorted(map(tuple, find_repeats(docs, most_in_class=most, batches=batches).collect()), key=str) == brute(rows)


def test_added_batches_find_old_texts(spark):
    """Four batches; each finds what it shares with any before it, in old texts too, and levels merge."""
    rows = made(3)
    texts = spark.createDataFrame([(i, t or "") for i, (_, t) in enumerate(rows)], "i int, text string").select("i", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"), "text")
    index, spans, heights = Index(spark), {}, []
    for b in range(4):
        batch = texts.where(F.col("i") % 4 == b).select("h1", "h2", "text")
        for r in index.add(batch).collect():
            spans.setdefault((r.h1, r.h2), set()).add((r.a, r.b, r.long))
        heights.append([h for h, _ in index.levels])
        here = [r for r in texts.where(F.col("i") % 4 <= b).collect()]
        for long, length in ((True, 400), (False, SHORT)):
            for r, gone in zip(here, covered([r.text.encode() for r in here], length)):
                got = np.zeros(len(gone), bool)
                for x, y, kind in spans.get((r.h1, r.h2), ()):
                    if kind == long:
                        got[x:y] = True
                assert (got == gone).all(), (b, r.i, long)
    assert heights == [[0], [1], [1, 0], [2]]


def test_long_periodic_texts(spark):
    """One key has all their anchors: equal neighbours are one entry."""
    rows = [(1, "x" * 30_000), (2, "abc" * 9_000), (3, "y" * 20_000 + "z"), (4, "plain")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in find_repeats(docs).collect()}
    assert got == {1: (30_000, 30_000, 1), 2: (27_000, 27_000, 1), 3: (20_001, 20_000, 1), 4: (5, 0, 0)}
    assert Index(spark).add(docs.select(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"), "text")).count() < 2000


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, find_repeats(docs).collect()), key=str) == brute(rows)


def test_family_finds_the_longest_prefix():
    rng = np.random.default_rng(1)
    rows = rng.integers(97, 99, (300, 12)).astype(np.uint8)
    family = Family(rows)
    for at in range(0, 300, 16):
        family.add(at, min(300, at + 16))
    assert len(family.levels) < 8
    order = family.whole()
    assert [bytes(rows[i]) for i in order] == sorted(map(bytes, rows))

    def prefix(a, b):
        return next((i for i in range(12) if a[i] != b[i]), 12)

    assert all(family.reach[i] == max(prefix(rows[i], rows[j]) for j in range(300) if j != i) for i in range(0, 300, 7))


def test_windows_in_parts_are_the_same():
    rng = np.random.default_rng(3)
    n = 60
    left, size = rng.integers(0, 4, n), rng.integers(20, 30, n)
    data = rng.integers(97, 99, size.sum()).astype(np.uint8)
    data[rng.random(size.sum()) < 0.9] = 97
    k, begin = np.sort(rng.integers(0, 3, n)), np.cumsum(size) - size
    want = []
    for length in (12, 16):
        # a window's class is its anchor's, and its distance to it
        windows = [(e, j, (k[e], left[e] - j, bytes(data[begin[e] + j : begin[e] + j + length]))) for e in range(n) for j in range(min(left[e] + 1, size[e] - length + 1))]
        seen = Counter(w for _, _, w in windows)
        want.append({(e, j) for e, j, w in windows if seen[w] > 1})
    assert all(want)
    for most in (10**6, 50, 1):
        for got, own in zip(repeats(k, left, left + 1, size, data, begin, lengths=(12, 16), run=8, most=most), want):
            # parts are by class; within one part equal strings at other distances count too
            assert own <= set(zip(*(x.tolist() for x in got)))


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 100, 57).astype(np.uint64)
    for w in (1, 3, 10, 57):
        assert sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(58 - w)]


def test_cleaned_texts(spark):
    rows = [(1, "é" * 300 + "aa"), (2, "é" * 300 + "bb"), (3, None), (4, "short"), (5, "wordy " * 52 + "five"), (6, "six " + "wordy " * 52)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)
    out = without_repeats(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "aa", 2: "bb", 3: None, 4: "short", 5: "five", 6: "six"}
    assert find_repeats(docs.where("false")).count() == 0

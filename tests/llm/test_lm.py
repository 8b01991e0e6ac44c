"""Counts and base scores against a plain version; the model is a probability and beats the counts."""

import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowdoc.llm.common import U64
from sparrowdoc.llm.lm import HEAD, SMOOTH, Model, Vocabulary, histories, score_texts

DOCS = "doc_id long, text string, score string, id int"


def toks(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", low), None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def brute(rows):
    c = Counter(t for i, x in rows if not held(i) for t in toks(x))
    n, v = c.total(), len(c)
    out = {}
    for i, x in rows:
        t = toks(x)
        out[i] = (held(i), len(t), sum(c[w] > 0 for w in t), n, sum(log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
    return out


def same(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS).repartition(3)
    want, got = brute(rows), score_texts(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9) and r.score < 0
    return got


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = [r for r in same(spark, rows) if r.held_out]
    assert sum(r.score for r in got) / sum(r.n_tokens for r in got) > sum(r.base_score for r in got) / sum(r.n_tokens for r in got) + 0.1


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (4, "A b\x0bC " * 60_000), (5, "é É x"), (10, "new words only"), (11, "x" * 200_000)]
    same(spark, rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert score_texts(docs.where("false")).count() == 0


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    token = rng.integers(1, 2**62, 2000).astype(U64)
    count = rng.integers(1, 500, 2000)
    words = Vocabulary(token, count, int(count.sum()), 2000)
    model = Model(rng.normal(size=Model().outer.shape).astype(np.float32), rng.normal(size=Model().inner.shape).astype(np.float32))
    rank, c = words.find(words.token)
    history = np.repeat(histories(token[:3], np.zeros(3, int))[2:], 2001, axis=0)
    p = np.exp(model.logs(history[:2000], rank))
    rest = rank >= HEAD
    p[rest] *= (c[rest] + SMOOTH) / (words.rest_total + SMOOTH * (words.rest_distinct + 1))
    unseen = np.exp(model.logs(history[:1], np.array([-1])))[0] * SMOOTH / (words.rest_total + SMOOTH * (words.rest_distinct + 1))
    assert p.sum() + unseen == pytest.approx(1, rel=1e-4)


def test_learning_lowers_the_loss():
    rng = np.random.default_rng(4)
    row = np.zeros(6000, int)
    rank = np.where(np.arange(6000) % 2, 5, 700 + rng.integers(0, 3, 6000))
    history = histories((rank + 10).astype(U64), row)
    model = Model()
    before = model.logs(history, rank).mean()
    model.start(0.2)
    for i in range(0, 6000, 500):
        model.step(history[i : i + 500], rank[i : i + 500])
    assert model.logs(history, rank).mean() > before + 3


def test_words_of_middle_frequency_hang_on_history(spark):
    """Words of ranks 512 to 1023 always follow one another in one order: texts in that order score above texts in another."""
    rows = [(i, " ".join(f"h{(i * 37 + k) % 500}" for k in range(100))) for i in range(400)]
    rows += [(1000 + i, " ".join(f"m{(i * 53 + k) % 400}" for k in range(60))) for i in range(400)]
    ordered, other = [f"m{k}" for k in range(100, 200)], [f"m{100 + k * 37 % 100}" for k in range(100)]
    held = [i for i in range(10_000, 11_000) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    rows += [(held[0], " ".join(ordered)), (held[1], " ".join(other))]
    got = {r.doc_id: r for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string")).where(F.col("doc_id").isin(held)).collect()}
    assert got[held[0]].base_score == pytest.approx(got[held[1]].base_score)
    assert got[held[0]].score > got[held[1]].score + 10


def test_scores_against_a_plain_model():
    """The log of each token's probability, term by term, from the weights."""
    import math

    from sparrowdoc.llm.common import mix
    from sparrowdoc.llm.lm import BITS, CLASSES, SIZE

    rng = np.random.default_rng(6)
    model = Model(rng.normal(size=Model().outer.shape).astype(np.float32), rng.normal(size=Model().inner.shape).astype(np.float32))
    token, row, rank = rng.integers(1, 2**62, 12).astype(U64), np.repeat([0, 1], 6), np.array([0, 5, HEAD - 1, HEAD, -1, 40, 7, HEAD + 9, 31, 32, 33, 1])
    history = histories(token, row)
    one = lambda x: int(mix(np.array([x & (2**64 - 1)], U64))[0])
    for i, got in enumerate(model.logs(history, rank)):
        place = i % 6
        last, before = (int(token[i - 1]) if place > 0 else 0), (int(token[i - 2]) if place > 1 else 0)
        features = [one(last + 1), one(one(last + 2) * 0x9E3779B97F4A7C15 + before), one(before + 3), 0x9E3779B97F4A7C15]
        assert features == [int(x) for x in history[i]]
        head = 0 <= rank[i] < HEAD
        group = int(rank[i]) // SIZE if head else CLASSES

        def log_share(weights, rows, want):
            sums = [sum(float(weights[r, j]) for r in rows) for j in range(weights.shape[1])]
            return sums[want] - math.log(sum(map(math.exp, sums)))

        want = log_share(model.outer, [f >> (64 - BITS) for f in features], group)
        if head:
            want += log_share(model.inner, [one(f + (group + 1) * 0x9FB21C651E98DF25) >> (64 - BITS) for f in features], int(rank[i]) % SIZE)
        assert got == pytest.approx(want, rel=1e-4)


def test_rare_words_hang_on_history(spark):
    """Words beyond those with weights of their own, always in one order: texts in that order score far above texts in another."""
    rows = [(i, " ".join(f"h{(i * 37 + k) % 1100}" for k in range(100))) for i in range(440)]
    rows += [(1000 + i, " ".join(f"r{(i * 53 + k) % 400}" for k in range(40))) for i in range(200)]
    ordered, other = [f"r{k}" for k in range(100, 200)], [f"r{100 + k * 37 % 100}" for k in range(100)]
    held = [i for i in range(10_000, 11_000) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    rows += [(held[0], " ".join(ordered)), (held[1], " ".join(other))]
    got = {r.doc_id: r for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string")).where(F.col("doc_id").isin(held)).collect()}
    assert got[held[0]].base_score == pytest.approx(got[held[1]].base_score)
    assert got[held[0]].score > got[held[1]].score + 100


def test_pairs_of_all_texts_are_counted(spark):
    """The pairs of the rest that occur twice, and each bucket's sums, against a plain count; tokens that are known and such that are not."""
    from sparrowdoc.llm import lm
    from sparrowdoc.llm.common import Scratch

    texts = [" ".join(f"w{(i * k * k) % 41}" for k in range(1, 30)) for i in range(60)] + ["", "a b a b"] + [" ".join(f"h{k}" for k in range(1020))] * 90
    data = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counts = data.mapInArrow(lm._count, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))
    every = counts.toArrow()
    some = np.flatnonzero(every.column("c").to_numpy() > 20)
    words = lm.Vocabulary(every.column("token").to_numpy().view(U64)[some], every.column("c").to_numpy()[some], sum(every.column("c").to_pylist()), len(every))
    kept = lm.remembered(data, words, Scratch(spark)).collect()
    want, sums = Counter(), Counter()
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        token, row = lm.tokens(raw, np.array([0, len(raw)]))
        last = histories(token, row)[:, 0] >> U64(64 - lm.LAST)
        for w, b, own in zip(token, last, words.in_head(token), strict=True):
            if not own:
                known = words.find(np.array([w]))[0][0] >= 0
                key = lm.pair(np.array([w]), np.array([b]))[0] if known else w
                want[int(np.int64(key.view(np.int64))), int(b) + (0 if known else 1 << lm.LAST)] += 1
                sums[int(b)] += 1
    assert len(some) > HEAD and {x[1] >> lm.LAST for x in want} == {0, 1} and max(want.values()) > 1
    assert {(r.key, r["last"]): r.c for r in kept} == {k: n for k, n in want.items() if n > 1}
    pairs = Counter(b % (1 << lm.LAST) for _, b in want)
    for b in sums:
        assert words.each[b] == pytest.approx(1 / sums[b]) and words.left[b] == pytest.approx(pairs[b] / sums[b])


def test_sums_of_runs():
    from sparrowdoc.llm.lm import sums_of_runs

    x = np.random.default_rng(5).normal(size=(200, 7)).astype(np.float32)
    for cut in ([0], [0, 1, 2, 4, 7, 100, 199], list(range(200)), list(range(0, 200, 2))):
        assert np.array_equal(sums_of_runs(x, np.array(cut)), np.add.reduceat(x, cut, axis=0))

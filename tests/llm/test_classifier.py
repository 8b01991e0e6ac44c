"""Held-out accuracy, and rows that are odd."""

import zlib

import numpy as np

from sparrowdoc.llm.classifier import Leader, accepted, classify, features

DOCS = "doc_id long, text string, score string, quality string"


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = classify(spark.read.parquet(f"{d}/documents.parquet"), labels)
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    truth = [(r.quality, rows[r.doc_id]) for r in labels.collect() if rows[r.doc_id].held_out]
    assert all(r.predicted == (r.score >= 0.5) for _, r in truth)
    assert np.mean([q == r.predicted for q, r in truth]) > 0.93
    bad, good = [r.score for q, r in truth if q == 0], [r.score for q, r in truth if q == 1]
    assert np.mean([b < g for b in bad for g in good]) > 0.95


def test_leader_separates():
    leader = Leader(4)
    for _ in range(50):
        leader.learn(np.array([0, 3]), np.array([1.0, 1.0]), 1)
        leader.learn(np.array([1, 3]), np.array([1.0, 1.0]), 0)
    w = leader.weights()
    assert w[0] > 0.5 > -0.5 > w[1] and w[2] == 0


def test_values_sum_to_scales():
    text = "One two two, THREE!! 4x".encode()
    index, row, value = features(np.frombuffer(text * 2, np.uint8), np.array([0, len(text), 2 * len(text)]))
    assert np.allclose(np.bincount(row, value), 36) and sorted(index[row == 0]) == sorted(index[row == 1])


def test_odd_rows(spark):
    rows = [(i, "good words in a line" if i % 2 else "BAD!! BAD!! BAD!!") for i in range(60)] + [(None, "x"), (100, None), (101, ""), (102, "z " * 200_000), (103, "z"), (103, "z")]
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (4, 1)], "doc_id long, quality int")
    got = classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 60)
    assert len({r.score for r in got if r.doc_id in (100, 101)}) == 1
    kept = accepted(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(1, 60, 2))
    assert {r.score for r in classify(docs, labels.where("false")).collect()} == {0.5}
    assert classify(docs.where("false"), labels).count() == 0

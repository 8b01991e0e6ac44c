"""Top-k against all products."""

import math

import numpy as np

from sparrowdoc.llm import q04_topk
from sparrowdoc.llm.topk import added_up, best_of_lists, below, collected, sliced, top_k

ROWS = "vec_id long, embedding array<double>, score string, rank int"


def brute(rows, k=5, every=50):
    ok = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.append((i, [math.floor(256 * x) for x in v]))
    out = []
    for n, (q, v) in enumerate(ok):
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(ok) if m != n)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_query(spark, sf):
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, q04_topk.query(spark, sf).collect())) == brute(rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    same = [0.5, -0.25, 1.0]
    rows = [(i, same) for i in range(0, 400)] + [(1000 + i, rng.normal(size=3).tolist()) for i in range(30)]
    rows += [(50, None), (None, same), (2001, [1.0, None, 2.0]), (2002, [float("nan"), 1.0, 1.0]), (2003, [float("inf"), 1.0, 1.0]), (2050, [1e6, -1e6, 3.0]), (2051, [1e6, 1e6, 1e6]), (7, same), (7, [0.1, 0.1, 0.1]), (1050, [0.3, 0.2, 0.1]), (1050, [0.2, 2.0, 0.1]), (2100, []), (2101, [2.0])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS).repartition(6)
    assert sorted(map(tuple, top_k(docs, lambda i: i % 50 == 0).collect())) == brute(rows)


def test_few_and_none(spark):
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k(two, lambda i: i % 50 == 0).collect()] == [(0, 1, 1, 131072)]
    assert top_k(two.where("false"), lambda i: i % 50 == 0).count() == 0


def test_pieces_give_the_same(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    few = top_k(rows, lambda i: i % 50 == 0, piece=2)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, top_k(rows, lambda i: i % 50 == 0).collect()))


def test_phases_add_up_few_entries():
    """The first two phases see lists alone; what is added up is a small part, and holds the best."""
    rng = np.random.default_rng(2)
    c = np.rint(rng.normal(size=(4000, 32)) * 20).astype(np.int64)
    c[:200] *= 6
    q, k = c[:40], 5
    own = np.arange(40)[:, None] == np.arange(4000)[None, :]
    parts = sliced(q, c, 4)
    some = best_of_lists([a @ b.T for a, b in parts], own, k)
    assert some.sum() <= 40 * 4 * k
    cut = np.array([np.sort(added_up(parts, *np.nonzero(some & (np.arange(40) == i)[:, None])))[-k] for i in range(40)])
    kept = collected(parts, below(cut)) & ~own
    assert kept.sum() < 0.1 * kept.size
    score = np.where(own, -(1 << 60), q @ c.T)
    for i in range(40):
        assert set(np.argsort(-score[i], kind="stable")[:k]) <= set(np.flatnonzero(kept[i]))


def test_plan_moves_no_rows(spark, sf):
    found = top_k(spark.read.parquet(f"{sf}/embeddings.parquet"), lambda i: i % 50 == 0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan

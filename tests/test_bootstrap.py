"""Resampling in blocks."""

import numpy as np
from pyspark.sql import functions as F

from sparrowdoc.operators import stats


def got(df):
    return sorted(((r.g, r.n, r.mean_diff, r.low, r.high) for r in df.collect()), key=str)


def test_plain_version(spark):
    """One block: draws of a plain loop over all items in order; more blocks: the same from any partitions, and near it."""
    rng = np.random.default_rng(1)
    rows = [(g, i, float(x)) for g, size in (("a", 90), (None, 40), ("b", 1)) for i, x in enumerate(rng.normal(size=size))] + [("a", 1000, None)]
    pairs = spark.createDataFrame(rows, "g string, i long, diff double")
    want = []
    for g in ("a", None, "b"):
        v = np.array([d for k, _, d in rows if k == g and d is not None])
        means = np.sort([v[stats._stream(42, b, 1).integers(0, len(v), len(v))].sum() / len(v) for b in range(400)])
        want.append((g, len(v), round(v.mean(), 9), round(means[10], 9), round(means[389], 9)))
    whole = got(stats.bootstrap_blocks(pairs, "g", "i", 400))
    assert np.allclose([r[2:] for r in whole], [r[2:] for r in sorted(want, key=str)], atol=2e-9) and [r[:2] for r in whole] == [r[:2] for r in sorted(want, key=str)]
    parts = [got(stats.bootstrap_blocks(pairs.repartition(p), "g", "i", 400, items=20)) for p in (1, 7)]
    assert parts[0] == parts[1] and [r[:3] for r in parts[0]] == [r[:3] for r in whole]
    assert all(abs(a[j] - b[j]) < 0.08 for a, b in zip(parts[0], whole) for j in (3, 4))
    assert stats.bootstrap_blocks(pairs.where("false"), "g", "i", 10).count() == 0


def test_a_million_items(spark):
    """An interval of a million items is as wide as the normal one."""
    pairs = spark.range(1_000_000).select(F.lit("all").alias("g"), F.col("id").alias("i"), F.rand(7).alias("diff"))
    _, n, mean, low, high = got(stats.bootstrap_blocks(pairs, "g", "i", 60))[0]
    assert n == 1_000_000 and low < mean < high and 0.5 < (high - low) / (3.9 * 12**-0.5 / 1000) < 1.5

"""Exact quantiles by narrowing brackets."""

import math
import random

import pytest

from sparrowdoc.operators import metrics


def brute(rows, percents):
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).extend([] if v is None or math.isnan(v) else [v])
    out = {}
    for g, vs in groups.items():
        vs.sort()
        out[g] = (len(vs), *(vs[max(1, math.ceil(len(vs) * p / 100)) - 1] if vs else None for p in percents))
    return out


@pytest.mark.parametrize("few", [1, 3, 100_000])
def test_brackets(spark, few):
    r = random.Random(4)
    rows = [("even", float(i)) for i in range(700)] + [("one", 5.0)] * 400 + [("skew", 2.0 ** r.randint(-900, 900)) for _ in range(500)] + [("wide", r.choice([-1.7e308, 1.7e308, 0.0, -0.0, 1e-300])) for _ in range(300)]
    rows += [(None, r.gauss(0, 1)) for _ in range(300)] + [("none", None), ("nan", float("nan")), ("nan", 1.0), ("few", 3.0), ("few", 1.0)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    percents = {"low": 0, "p50": 50, "p95": 95, "high": 100}
    got = {x.g: (x.n, x.low, x.p50, x.p95, x.high) for x in metrics.exact_quantiles(df, ["g"], "v", percents, few).collect()}
    assert got == brute(rows, percents.values())


def test_whole_numbers_and_plan(spark):
    """Types stay; no aggregate of the plan holds values; no rows are no groups."""
    df = spark.range(1000).selectExpr("id % 3 as a", "id % 2 as b", "id as v")
    found = metrics.exact_quantiles(df, ["a", "b"], "v", {"p50": 50}, 5)
    assert dict(found.dtypes)["p50"] == "bigint" and sorted(map(tuple, found.collect()))[0] == (0, 0, 167, 498)
    assert "percentile" not in spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted").lower()
    assert metrics.exact_quantiles(df.where("false"), ["a"], "v", {"p50": 50}).count() == 0

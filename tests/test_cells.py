"""The vector index: recall, all rows filed, exact answers, cells that are not read."""

import numpy as np
from pyspark.sql import functions as F

from sparrowdoc.operators import cells
from sparrowdoc.operators.cells import VectorIndex, recall
from sparrowdoc.operators.retrieve import dense_topk


def rows_of(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def clustered(n=1500, dim=10):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, dim))
    return [(i, (centres[i % 30] + rng.normal(size=dim) / 8).tolist()) for i in range(n)]


ODD = [(5000, None), (None, [1.0] * 10), (5001, [0.0] * 10), (5002, [1.0, 2.0]), (5003, [0.5] * 10), (5003, [0.25] * 10)]


def test_clusters(spark, tmp_path):
    """Groups of vectors need few cells; only these are read, and nine in ten of the true neighbours are found."""
    rows = spark.createDataFrame(clustered() + ODD, "vec_id long, embedding array<double>")
    asked = rows.where("vec_id % 50 = 0")
    index = VectorIndex(spark, str(tmp_path / "v")).create(rows)
    assert index.read().count() == 1500 + 4 and index.model.probes < len(index.model.centres) / 2
    found = index.search(asked, 10)
    got = recall(found, dense_topk(rows, asked, 10)).first()
    assert got.recall >= 0.9 and got.queries == 30 and got.wanted == 300
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "cell" in plan
    every = index.search(asked, 10, probes=10**6, refine=10**6)
    assert rows_of(every) == rows_of(dense_topk(rows, asked, 10)) == rows_of(index.search(asked, 10, exact=True))


def test_pieces_and_odd_rows(spark, tmp_path, monkeypatch):
    """Queries in pieces give what they give at once; nothing to index or to ask is no error."""
    rows = spark.createDataFrame(clustered(200) + ODD, "vec_id long, embedding array<double>")
    index = VectorIndex(spark, str(tmp_path / "v")).create(rows, cells=7)
    asked = rows.select((F.col("vec_id") + 0).alias("vec_id"), "embedding")
    whole = rows_of(index.search(asked, 3))
    monkeypatch.setattr(cells, "PIECE_BYTES", 4000)
    monkeypatch.setattr(cells, "ROWS", 13)
    assert rows_of(index.search(asked, 3)) == whole and len(whole) > 3 * 195
    assert index.search(asked.where("false"), 3).count() == 0
    empty = VectorIndex(spark, str(tmp_path / "e")).create(rows.where("false"))
    assert empty.search(asked, 3).count() == 0 and empty.search(asked, 3, exact=True).count() == 0

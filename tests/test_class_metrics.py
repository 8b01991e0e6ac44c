"""Rank metrics whose gold is a class."""

from pyspark.sql import functions as F

from sparrowdoc.operators import metrics


def test_a_class_is_its_pairs(spark):
    """The same rows as with all pairs of query and gold, and none of these pairs in the plan's joins."""
    rows = spark.range(60).select(F.col("id").alias("doc_id"), F.expr("case when id = 7 then null when id = 11 then 99 else id % 5 end").alias("class"))
    asked = rows.where("doc_id % 4 in (0, 3)").withColumnRenamed("doc_id", "query_id")
    found = asked.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("rank")).selectExpr("query_id", "cast(rank as int) as rank", "(query_id * 7 + rank * rank) % 61 as doc_id").where("query_id <> 8")
    gold = asked.join(rows, "class").where("query_id <> doc_id").select("query_id", "doc_id")
    same = lambda df: sorted(map(tuple, df.collect()), key=repr)
    got = metrics.class_rank_metrics(found, asked, rows)
    assert same(got) == same(metrics.rank_metrics(found.where("query_id <> doc_id or rank < 0").unionByName(found.where("query_id = doc_id")), gold))
    assert {7, 11}.isdisjoint({r.query_id for r in got.collect()})

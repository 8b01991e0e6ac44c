"""Stored tables: keyed upserts by bucket, point lookups, the inverted index, the vector index."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparrowdoc.operators.cells import VectorIndex, recall
from sparrowdoc.operators.inverted import InvertedIndex
from sparrowdoc.operators.retrieve import dense_topk
from sparrowdoc.plans.catalogue import query
from sparrowdoc.plans.retrieval import DENSE, _passages, bm25
from sparrowdoc.sources.shared import Workspace
from sparrowdoc.sources.store import KeyedTable


@query("""WITH u AS (SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 50 = 0) UNION ALL SELECT doc_id, 'label', quality::BIGINT FROM labels WHERE doc_id % 50 = 0),
d AS (SELECT * FROM u WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 50 = 1))
SELECT d.doc_id, CASE WHEN d.doc_id % 50 = 2 AND l.quality = 0 THEN 'poor' ELSE d.lang END AS lang, d.n_chars FROM d LEFT JOIN labels l USING (doc_id)""")
def keyed_table_updates(spark, t):
    """A keyed table after an upsert, a delete and a backfill, each of which rewrites the buckets of its keys."""
    table = KeyedTable(spark, Workspace(spark).path("documents"), "doc_id", 256).create(t("documents").select("doc_id", "lang", "n_chars"))
    labels = t("labels")
    table.upsert(labels.where("doc_id % 50 = 0").select("doc_id", F.lit("label").alias("lang"), F.col("quality").cast("long").alias("n_chars")))
    table.delete(labels.where("doc_id % 50 = 1"))
    table.backfill(labels.where("doc_id % 50 = 2").select("doc_id", F.expr("case when quality = 0 then 'poor' end").alias("lang")), ["lang"])
    return table.read()


@query("SELECT doc_id, source, n_chars FROM documents WHERE doc_id % 200 = 7 OR doc_id IN (SELECT doc_id + 1 FROM documents WHERE doc_id % 200 = 7)")
def point_lookup(spark, t):
    """Rows by id, and those that follow them, from a keyed table."""
    table = KeyedTable(spark, Workspace(spark).path("documents"), "doc_id").create(t("documents").select("doc_id", "source", "n_chars"))
    asked = t("documents").where("doc_id % 200 = 7").select("doc_id")
    return table.lookup(asked.union(asked.select(F.col("doc_id") + 1)))


def _index(spark, t):
    """Documents, of which every seventh was put in anew after the first writing, with some that are not documents and are deleted."""
    docs = t("documents").select("doc_id", "text")
    early = docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat_ws(" ", F.lit("an earlier text"), F.substring("text", 1, 60))).otherwise(F.col("text")))
    extra = docs.where("doc_id % 11 = 0").select((-1 - F.col("doc_id")).alias("doc_id"), "text")
    index = InvertedIndex(spark, Workspace(spark).path("index"), 16).create(early.union(extra))
    index.upsert(docs.where("doc_id % 7 = 0"))
    index.delete(extra)
    return index


@query(f"WITH {bm25()} SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 10")
def bm25_from_index(spark, t):
    """The same rows as bm25_topk, from stored postings, after an upsert and a delete."""
    return _index(spark, t).search(_passages(t), 10)[0].select("query_id", "rank", "doc_id", "score")


@query(f"""WITH {bm25(where="WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND n_chars >= 200 AND n_chars < 5000)")} SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 10""")
def bm25_from_index_filtered(spark, t):
    """The same rows as bm25_filtered, from stored postings."""
    allowed = t("documents").where("lang in ('en', 'fr') and n_chars >= 200 and n_chars < 5000")
    index = InvertedIndex(spark, Workspace(spark).path("index"), 16).create(t("documents"))
    return index.search(_passages(t), 10, allowed=allowed)[0].select("query_id", "rank", "doc_id", "score")


@query(f"WITH {DENSE} SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10")
def vector_index_exact(spark, t):
    """The same rows as dense_topk, from the stored cells, all of them."""
    rows = t("embeddings")
    index = VectorIndex(spark, Workspace(spark).path("cells")).create(rows)
    return index.search(rows.where("vec_id % 50 = 0"), 10, exact=True).select("query_id", "rank", "vec_id", "score")


@query()
def vector_index_recall(spark, t):
    """The index' ten nearest, by codes and an exact second pass, against those of all rows."""
    rows = t("embeddings")
    asked = rows.where("vec_id % 50 = 0")
    index = VectorIndex(spark, Workspace(spark).path("cells")).create(rows)
    return recall(index.search(asked, 10), dense_topk(rows, asked, 10)).select("queries", "wanted", "found", "recall", (F.col("recall") >= 0.9).alias("enough"), F.lit(len(index.model.centres)).alias("cells"), F.lit(index.model.probes).alias("probes"), F.lit(index.model.refine).alias("refine"))

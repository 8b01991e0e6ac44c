"""BM25, vectors, fusion, filters, diversity and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparrowdoc.functions import text as T
from sparrowdoc.operators import chunk, retrieve
from sparrowdoc.operators import metrics as M
from sparrowdoc.plans.catalogue import query
from sparrowdoc.plans.corpus import CHUNKS, TOKENS
from sparrowdoc.sources.shared import Workspace


def bm25(docs: str = TOKENS, n: str = "(SELECT count(*) FROM documents)", where: str = "") -> str:
    """CTEs up to ranked BM25 results `r` (query_id, doc_id, score, rank)."""
    return rf"""k AS ({docs}), post AS (SELECT doc_id, term, count(*) AS tf FROM k GROUP BY ALL), dl AS (SELECT doc_id, count(*) AS doc_len FROM k GROUP BY 1),
st AS (SELECT {n} AS n_docs, (SELECT count(*) FROM k)::DOUBLE / {n} AS avg_len), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
qt AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM benchmark),
sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * doc_len / avg_len)))), 6) AS score
  FROM qt JOIN post USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st {where} GROUP BY ALL),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM sc)"""


def _passages(t):
    return t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(f"WITH {bm25()} SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 10")
def bm25_topk(spark, t):
    return retrieve.bm25_topk(t("documents"), _passages(t), 10).select("query_id", "rank", "doc_id", "score")


@query(f"""WITH {bm25(where="WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND n_chars >= 200 AND n_chars < 5000)")} SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 10""")
def bm25_filtered(spark, t):
    where = retrieve.payload_filter({"lang": ["en", "fr"], "n_chars": {"gte": 200, "lt": 5000}})
    return retrieve.bm25_topk(t("documents"), _passages(t), 10, where).select("query_id", "rank", "doc_id", "score")


DENSE = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 6) AS score FROM q JOIN v ON q.vec_id <> v.vec_id),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)"""


def dense_results(t, k=10, half=False):
    rows = t("embeddings")
    if half:
        rows = rows.withColumn("embedding", F.slice("embedding", 1, 32))
    return retrieve.dense_topk(rows, rows.where("vec_id % 50 = 0"), k)


@query(f"WITH {DENSE} SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10")
def dense_topk(spark, t):
    return dense_results(t).select("query_id", "rank", "vec_id", "score")


OVERLAP = r"""qd AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM benchmark),
ov AS (SELECT query_id, doc_id, count(*) AS n FROM qt JOIN post USING (term) GROUP BY ALL),
o AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY n DESC, doc_id))::INTEGER AS rank FROM ov)"""


@query(f"""WITH {bm25()}, {OVERLAP}, legs AS (SELECT query_id, doc_id, 'bm25' AS leg, rank FROM r WHERE rank <= 50 UNION ALL SELECT query_id, doc_id, 'overlap', rank FROM o WHERE rank <= 50),
f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, max(rank) FILTER (leg = 'bm25') AS bm25_rank, max(rank) FILTER (leg = 'overlap') AS overlap_rank FROM legs GROUP BY ALL),
x AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM f)
SELECT query_id, rank, doc_id, score, bm25_rank, overlap_rank FROM x WHERE rank <= 12""")
def hybrid_rrf(spark, t):
    docs, asked = t("documents"), _passages(t)
    legs = {"bm25": retrieve.bm25_topk(docs, asked, 50), "overlap": retrieve.bm25_topk(docs, asked, 50, weighed=False)}
    return retrieve.fused(legs, 12).select("query_id", "rank", "doc_id", "score", "bm25_rank", "overlap_rank")


BOTH = r"""d AS (SELECT doc_id, text, lang, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM documents JOIN embeddings ON doc_id = vec_id), q AS (SELECT doc_id AS query_id, substr(text, 1, 80) AS query, e FROM d WHERE doc_id % 50 = 0),
k AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM d), post AS (SELECT doc_id, term, count(*) AS tf FROM k GROUP BY ALL), dl AS (SELECT doc_id, count(*) AS doc_len FROM k GROUP BY 1),
st AS (SELECT (SELECT count(*) FROM d) AS n_docs, (SELECT count(*) FROM k)::DOUBLE / (SELECT count(*) FROM d) AS avg_len), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}]+')) AS term FROM q),
ls AS (SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * doc_len / avg_len)))), 6) AS score FROM qt JOIN post USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st
  WHERE query_id <> doc_id AND doc_id IN (SELECT doc_id FROM d WHERE lang IN ('en', 'fr')) GROUP BY ALL),
lr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ls),
ds AS (SELECT query_id, doc_id, round(list_dot_product(q.e, d.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(d.e, d.e))), 6) AS score FROM q JOIN d ON query_id <> doc_id WHERE lang IN ('en', 'fr')),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ds),
legs AS (SELECT query_id, doc_id, 'bm25' AS leg, rank FROM lr WHERE rank <= 50 UNION ALL SELECT query_id, doc_id, 'dense', rank FROM dr WHERE rank <= 50),
f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, (max(rank) FILTER (leg = 'bm25'))::INTEGER AS bm25_rank, (max(rank) FILTER (leg = 'dense'))::INTEGER AS dense_rank FROM legs GROUP BY ALL),
x AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM f)"""


@query(f"WITH {BOTH} SELECT query_id, rank, doc_id, score, bm25_rank, dense_rank FROM x WHERE rank <= 12")
def hybrid_dense_bm25(spark, t):
    """BM25 and cosine similarity, the filter inside each leg."""
    docs = t("documents").join(t("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id").select("doc_id", "text", "lang", "embedding")
    docs = Workspace(spark).keep(docs)  # each leg reads them several times, and would move all texts anew
    asked = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 80).alias("query"), "embedding")
    return retrieve.hybrid(docs, asked, where=retrieve.payload_filter({"lang": ["en", "fr"]})).select("query_id", "rank", "doc_id", "score", "bm25_rank", "dense_rank")


PLANS = "CASE WHEN conv_id % 5 = 0 THEN NULL WHEN conv_id % 7 = 0 THEN ' ' ELSE text || ' ' END"


@query(f"""WITH r AS (SELECT *, {PLANS} AS w, conv_id % 2 = 0 AS agg, 1980 + conv_id % 60 AS y FROM conversations WHERE turn = 1), f AS (SELECT *, w IS NULL OR trim(w) = '' AS bad FROM r)
SELECT conv_id AS query_id, CASE WHEN bad THEN text ELSE trim(w) END AS search, CASE WHEN NOT bad AND agg THEN 25 ELSE 8 END AS top_n, CASE WHEN NOT bad AND agg AND y BETWEEN 1990 AND 2100 THEN y || '-01-01T00:00:00' END AS since, bad AS degraded FROM f""")
def rewrite_plans(spark, t):
    """Recorded rewrites; a failed one changes nothing."""
    rows = t("conversations").where("turn = 1").select(F.col("conv_id").alias("query_id"), F.col("text").alias("query"), F.expr(PLANS.replace("text || ' '", "concat(text, ' ')")).alias("rewritten"), F.expr("cast(1980 + conv_id % 60 as int)").alias("year"), F.expr("conv_id % 2 = 0").alias("aggregate"))
    return retrieve.rewrite_plans(rows).select("query_id", "search", "top_n", F.col("date_range.gte").alias("since"), "degraded")


@query("""WITH g AS (SELECT conv_id AS query_id, turn, CASE WHEN (conv_id + turn) % 4 = 0 THEN NULL WHEN (conv_id + turn) % 9 = 0 THEN '  ' ELSE 's' || turn END AS s, text FROM conversations), d AS (SELECT *, s IS NULL OR trim(s) = '' AS degraded FROM g)
SELECT query_id, turn, md5(CASE WHEN degraded THEN text ELSE s END) AS content, degraded, avg(degraded::INTEGER) OVER (PARTITION BY query_id) > 0.3 AS falls_back FROM d""")
def map_summaries(spark, t):
    """A failed summary is its first block; too many of them, and the query falls back."""
    s = F.expr("case when (conv_id + turn) % 4 = 0 then null when (conv_id + turn) % 9 = 0 then '  ' else concat('s', turn) end")
    rows = t("conversations").select(F.col("conv_id").alias("query_id"), "turn", s.alias("summary"), F.array("text", F.lit("later")).alias("blocks"))
    return retrieve.summarised(rows).select("query_id", "turn", F.md5("content").alias("content"), "degraded", "falls_back")


NARROW = "WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'fr' AND n_chars < 300)"


@query(f"""WITH {bm25(where=NARROW)}, f AS (SELECT * FROM r WHERE rank <= 8), n AS (SELECT item_id AS query_id, (SELECT count(*) FROM f WHERE f.query_id = item_id) AS n_before_fallback FROM benchmark),
sc2 AS (SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * doc_len / avg_len)))), 6) AS score
  FROM qt JOIN post USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
u AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM sc2)
SELECT query_id, rank, doc_id, score, n_before_fallback, false AS filter_fallback FROM f JOIN n USING (query_id) WHERE n_before_fallback >= 3
UNION ALL SELECT query_id, rank, doc_id, score, n_before_fallback, true FROM u JOIN n USING (query_id) WHERE n_before_fallback < 3 AND rank <= 8""")
def filtered_with_fallback(spark, t):
    docs, asked = t("documents"), _passages(t)
    found = retrieve.bm25_with_fallback(docs, asked, 8, retrieve.payload_filter({"lang": "fr", "n_chars": {"lt": 300}}))
    return found.select("query_id", "rank", "doc_id", "score", "n_before_fallback", "filter_fallback")


CHUNK_TOKENS = rf"SELECT doc_id || ':' || lpad(chunk_no::VARCHAR, 5, '0') AS doc_id, unnest(regexp_extract_all(lower(chunk), '[\p{{L}}\p{{N}}]+')) AS term FROM ({CHUNKS})"


@query(f"""WITH {bm25(CHUNK_TOKENS, f"(SELECT count(*) FROM ({CHUNKS}))")}, p AS (SELECT *, split_part(doc_id, ':', 1)::BIGINT AS doc FROM r WHERE rank <= 50),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc ORDER BY rank) AS n FROM p), x AS (SELECT query_id, doc, doc_id AS chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY rank))::INTEGER AS rank FROM d WHERE n = 1)
SELECT query_id, rank, doc AS doc_id, chunk_id FROM x WHERE rank <= 8""")
def aggregate_doc_diverse(spark, t):
    chunks = chunk.chunk_fixed(t("documents")).select(F.concat_ws(":", "doc_id", F.lpad(F.col("chunk_no").cast("string"), 5, "0")).alias("doc_id"), F.col("chunk").alias("text"))
    found = retrieve.bm25_topk(chunks, _passages(t), 50).withColumn("chunk_id", F.col("doc_id")).withColumn("doc_id", F.split_part("chunk_id", F.lit(":"), F.lit(1)).cast("long"))
    return retrieve.diverse(found, 8).select("query_id", "rank", "doc_id", "chunk_id")


@query(f"""WITH {DENSE}, l AS (SELECT r.*, CASE WHEN query_id % 100 = 0 THEN NULL ELSE v.label * 10 + r.vec_id % 7 END AS model_score FROM r JOIN v USING (vec_id) WHERE rank <= 12),
m AS (SELECT *, count(*) FILTER (model_score IS NULL) OVER (PARTITION BY query_id) > 0 AS rerank_failed FROM l)
SELECT query_id, vec_id, rank AS fused_rank, new_rank AS rank, rerank_failed FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN NOT rerank_failed THEN -model_score END NULLS FIRST, rank))::INTEGER AS new_rank FROM m) WHERE new_rank <= 5""")
def rerank_and_budget(spark, t):
    model = F.when(F.col("query_id") % 100 != 0, F.col("label") * 10 + F.col("vec_id") % 7)
    listed = dense_results(t, 12).join(t("embeddings").select("vec_id", "label"), "vec_id").withColumn("model_score", model)
    return retrieve.budgeted(retrieve.reranked(listed, "model_score"), 0, 6, 5).select("query_id", "vec_id", "fused_rank", "rank", "rerank_failed")


@query(f"""WITH {DENSE}, c AS (SELECT query_id, label AS doc, rank AS no FROM r JOIN v USING (vec_id) WHERE rank <= 10),
g AS (SELECT query_id, doc, min(no) AS first_no, count(*) AS blocks FROM c GROUP BY ALL)
SELECT query_id, doc, first_no, blocks, (row_number() OVER (PARTITION BY query_id ORDER BY first_no))::INTEGER AS doc_no FROM g""")
def contexts_by_document(spark, t):
    contexts = dense_results(t).join(t("embeddings").select("vec_id", F.col("label").alias("doc")), "vec_id").select("query_id", "doc", F.col("rank").alias("no"))
    return retrieve.grouped_by_document(contexts).select("query_id", "doc", "first_no", "blocks", "doc_no")


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def passage_containment(spark, t):
    return retrieve.containing(t("documents"), t("benchmark").select("item_id", F.col("text").alias("phrase")))


@query(f"""WITH {bm25()}, gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
ng AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1), fh AS (SELECT query_id, min(rank) AS first_hit FROM r JOIN gold USING (query_id, doc_id) WHERE rank <= 10 GROUP BY 1)
SELECT count(*) AS n, round(avg((coalesce(first_hit, 99) <= 5)::INTEGER), 4) AS hit_at_k, round(avg((first_hit IS NOT NULL)::INTEGER), 4) AS hit_at_list, round(avg(coalesce(1.0 / first_hit, 0)), 4) AS mrr FROM ng LEFT JOIN fh USING (query_id)""")
def passage_hit_mrr(spark, t):
    docs, asked = t("documents"), _passages(t)
    gold = retrieve.containing(docs, t("benchmark").select("item_id", F.col("text").alias("phrase"))).withColumnRenamed("item_id", "query_id")
    per_query = M.rank_metrics(retrieve.bm25_topk(docs, asked, 10), gold)
    return M.retrieval_summary(per_query).select("n", "hit_at_k", "hit_at_list", "mrr")

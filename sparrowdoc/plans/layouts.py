"""Layout, block trees, evidence loops and summaries; the tables stand for what parsers and models would give."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparrowdoc.functions import text as T
from sparrowdoc.operators import evidence, layout
from sparrowdoc.plans.catalogue import query

LINES = """SELECT conv_id AS doc_id, turn AS no, CASE WHEN turn % 4 = 3 THEN 'a long line' ELSE upper(left(role, 2)) END AS text, 12.0::DOUBLE * turn + CASE WHEN conv_id % 5 = 0 AND turn > 1 THEN 30 ELSE 0 END AS y0 FROM conversations"""


@query(f"""WITH l AS ({LINES}), m AS (SELECT *, y0 + 10 AS y1, length(text) <= 2 AS short, lag(length(text) <= 2) OVER w AS was, lag(y0 + 10) OVER w AS above FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY no)),
r AS (SELECT *, sum(CASE WHEN coalesce(short AND was AND y0 - above <= 16, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS run FROM m),
g AS (SELECT doc_id, run, min(no) AS no, string_agg(text, '' ORDER BY no) AS line FROM r GROUP BY 1, 2) SELECT doc_id, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY no) AS text FROM g GROUP BY 1""")
def merged_lines(spark, t):
    text = F.expr("case when turn % 4 = 3 then 'a long line' else upper(left(role, 2)) end")
    y0 = 12.0 * F.col("turn") + F.expr("case when conv_id % 5 = 0 and turn > 1 then 30 else 0 end")
    rows = t("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("no"), text.alias("text"), y0.alias("y0")).withColumn("y1", F.col("y0") + 10)
    return layout.merged_lines(rows, ["doc_id"])


@query("""WITH b AS (SELECT p_partkey, p_brand, p_size, p_size % 10 AS x FROM part), k AS (SELECT *, greatest(0, least(x + 4, 5) - greatest(x, 0)) / 4.0::DOUBLE AS share FROM b)
SELECT p_partkey AS block_no, p_brand AS page FROM k WHERE share <= 0.5""")
def blocks_outside_tables(spark, t):
    box = lambda a, b: F.array(a.cast("double"), F.lit(0.0), b.cast("double"), F.lit(1.0))
    x = F.col("p_size") % 10
    blocks = t("part").select(F.col("p_brand").alias("page"), F.col("p_partkey").alias("block_no"), box(x, x + 4).alias("bbox"))
    tables = blocks.select("page").distinct().withColumn("bbox", box(F.lit(0), F.lit(5)))
    return layout.outside_tables(blocks, tables, ["page"]).select("block_no", "page")


@query("""WITH b AS (SELECT p_brand AS doc_id, p_partkey, p_name AS text, p_size::DOUBLE AS size, p_partkey % 5 AS page, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey % 5, p_size, p_partkey) AS block_no FROM part),
m AS (SELECT doc_id, median(size) AS med FROM b GROUP BY 1) SELECT doc_id, p_partkey, block_no::INTEGER AS block_no, CASE WHEN size >= med * 1.15 AND length(text) <= 60 THEN 'heading' ELSE 'paragraph' END AS type FROM b JOIN m USING (doc_id)""")
def heading_heuristic(spark, t):
    rows = t("part").select(F.col("p_brand").alias("doc_id"), "p_partkey", F.col("p_name").alias("text"), F.col("p_size").cast("double").alias("size"), (F.col("p_partkey") % 5).alias("page"), F.lit("paragraph").alias("type"))
    placed = layout.in_reading_order(rows.withColumn("y", F.col("size")).withColumn("x", F.col("p_partkey")))
    return layout.with_headings(placed).select("doc_id", "p_partkey", "block_no", "type")


@query("""SELECT n_nationkey::VARCHAR AS doc_id, i::INTEGER AS block_no, ['heading', 'paragraph', 'table'][i] AS type, [n_name, 'nation ' || n_nationkey, '| key | name |' || chr(10) || '|---|---|' || chr(10) || '| ' || n_nationkey || ' | ' || n_name || ' |'][i] AS text FROM nation, range(1, 4) AS r(i)""")
def tree_blocks(spark, t):
    block = lambda i, code, text, children=(), columns=None: F.struct(F.lit(i).alias("id"), F.lit(code).alias("code"), text.alias("text"), F.array(*map(F.lit, children)).cast("array<string>").alias("children"), F.lit(columns).cast("int").alias("columns"))
    name, key = F.col("n_name"), F.col("n_nationkey").cast("string")
    tree = F.array(
        block("c4", 32, name), block("r", 1, name, ("h", "v", "x")), block("p", 2, F.concat(F.lit("nation "), key)), block("h", 3, name), block("v", 24, F.lit(""), ("p", "t")), block("t", 31, F.lit(""), ("c1", "c2", "c3", "c4"), 2), block("c1", 32, F.lit("key")), block("c2", 32, F.lit("name")), block("c3", 32, key),
    )
    return layout.tree_blocks(t("nation").select(F.col("n_nationkey").alias("doc_id"), tree.alias("blocks"))).select("doc_id", "block_no", "type", "text")


ROUNDS = """SELECT conv_id AS query_id, turn + 1 AS round, conv_id % 17 = 0 AS degraded, conv_id % 3 = 0 AND turn = 1 AS sufficient, length(text) AS prompt_tokens, CASE WHEN conv_id % 5 <> 0 OR turn = 0 THEN 'next' END AS next_query, (conv_id + turn) % 4 AS fresh FROM conversations"""


def _rounds(t):
    return t("conversations").selectExpr("conv_id as query_id", "turn + 1 as round", "conv_id % 17 = 0 as degraded", "conv_id % 3 = 0 and turn = 1 as sufficient", "length(text) as prompt_tokens", "case when conv_id % 5 <> 0 or turn = 0 then 'next' end as next_query", "(conv_id + turn) % 4 as fresh")


STOPPED = f"""r AS ({ROUNDS}), u AS (SELECT *, sum(prompt_tokens) OVER (PARTITION BY query_id ORDER BY round) AS used FROM r), w AS (SELECT *, CASE WHEN degraded THEN 'judge_degraded' WHEN sufficient THEN 'sufficient' WHEN used >= 1500 THEN 'token_budget'
  WHEN round >= 3 THEN 'steps_exhausted' WHEN next_query IS NULL THEN 'no_next_query' WHEN fresh = 0 THEN 'no_new_evidence' END AS reason FROM u),
f AS (SELECT query_id, coalesce(min(round) FILTER (reason IS NOT NULL), max(round)) AS stop_round FROM w GROUP BY 1), e AS (SELECT f.query_id, stop_round, coalesce(reason, 'steps_exhausted') AS stop_reason, used::BIGINT AS used_tokens FROM f JOIN w ON w.query_id = f.query_id AND w.round = f.stop_round)"""


@query(f"WITH {STOPPED} SELECT * FROM e")
def evidence_stops(spark, t):
    return evidence.stops(_rounds(t), 3, 1500)


@query(f"""WITH {STOPPED}, c AS (SELECT conv_id AS query_id, turn + 1 AS round, 'c' || (turn % 3) AS chunk_id, (conv_id % 7 + turn)::DOUBLE AS score FROM conversations), o AS (SELECT c.* FROM c JOIN e USING (query_id) WHERE round <= stop_round),
x AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY round) AS n FROM o) SELECT query_id, chunk_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, round, chunk_id))::INTEGER AS rank FROM x WHERE n = 1""")
def evidence_union(spark, t):
    found = t("conversations").selectExpr("conv_id as query_id", "turn + 1 as round", "concat('c', turn % 3) as chunk_id", "double(conv_id % 7 + turn) as score")
    return evidence.union_of_rounds(found, evidence.stops(_rounds(t), 3, 1500)).select("query_id", "chunk_id", "score", "rank")


@query("""SELECT conv_id % 2 = 0 AS aggregate, CASE WHEN conv_id % 2 <> 0 THEN 'single' WHEN turn % 2 = 0 THEN 'time_filter' ELSE 'cross_doc' END AS type, count(*) AS n FROM conversations GROUP BY ALL""")
def question_routes(spark, t):
    rows = t("conversations").select(F.expr("conv_id % 2 = 0").alias("aggregate"), evidence.routed(F.expr("conv_id % 2 = 0"), F.expr("turn % 2 = 0")).alias("type"))
    return rows.groupBy("aggregate", "type").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT conv_id, list(turn ORDER BY turn) AS t, max(text) AS m FROM conversations GROUP BY 1)
SELECT conv_id, md5(array_to_string(list_transform(t, lambda x: '[' || (x + 1) || '] （d' || x || CASE WHEN x % 2 = 0 THEN ' 第' || (x + 3) || '页' ELSE '' END || '）' || chr(10) || 's' || x), chr(10) || chr(10))) AS context, true AS replays FROM c""")
def summary_contexts(spark, t):
    """A context of summaries from its parts, and the same from the stored blocks."""
    turns = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    rows = turns.select(
        "conv_id", F.transform("t", lambda x: F.struct(F.array((x + 1).cast("int")).alias("nos"), F.concat(F.lit("s"), x.cast("string")).alias("text"))).alias("s"),
        F.transform("t", lambda x: F.concat(F.lit("d"), x.cast("string"))).alias("docs"), F.transform("t", lambda x: F.when(x % 2 == 0, (x + 3).cast("int"))).alias("pages"),
    )
    blocks = F.transform(F.arrays_zip(F.col("docs"), F.col("pages")), lambda z, i: T.context_block((i + 1).cast("int"), z["docs"], z["pages"], F.lit("body\nmore")))
    out = rows.withColumn("blocks", blocks)
    whole, again = evidence.summary_context(F.col("s"), F.col("docs"), F.col("pages")), evidence.replayed_context(F.col("s"), F.col("blocks"))
    return out.select("conv_id", F.md5(whole).alias("context"), (whole == again).alias("replays"))


@query("""SELECT doc_id, length(text) + CASE WHEN doc_id % 2 = 0 THEN 5 ELSE 0 END AS terms_chars, length(text) AS dense_chars FROM documents""")
def contextual_prefixes(spark, t):
    rows = layout.with_prefix(t("documents").select("doc_id", F.col("text").alias("indexed")), F.expr("case when doc_id % 2 = 0 then 'head' end"), "terms")
    return rows.select("doc_id", F.length("terms_text").alias("terms_chars"), F.length("dense_text").alias("dense_chars"))

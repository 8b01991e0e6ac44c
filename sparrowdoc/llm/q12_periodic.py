"""op12: periodic runs of every document, some of which are made periodic by a rule on their id."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowdoc.llm.periodic import periodic_runs

SQL = r"""
WITH t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w, len(w) AS n,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h FROM documents, t),
g AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM h),
d AS (SELECT doc_id, n, list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) AS w FROM g),
x AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS w FROM d),
m AS (SELECT a.doc_id, b.i - a.i AS p, a.i FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.w = b.w AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
s AS (SELECT doc_id, p, min(i) AS s, max(i) + 1 + p AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS k FROM m) GROUP BY doc_id, p, k HAVING e - s >= greatest(6, 4 * p)),
r AS (SELECT doc_id, s, e - s AS len, min(p) AS p FROM s GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len::DECIMAL(18, 9) / p DESC, s, p) AS k FROM r),
b AS (SELECT doc_id, count(*) AS n_runs, max(s) FILTER (k = 1) AS start, max(len) FILTER (k = 1) AS length, max(p) FILTER (k = 1) AS period, string_agg(s || ',' || len || ',' || p || chr(10), '' ORDER BY s, p) AS runs FROM o GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + p, s + len)) AS i FROM r),
c AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)
"""

WORDS = r"[^\x20\x09-\x0D]+"


def made_periodic(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of docs; where crc32 of the id ends in 0, the words from one on repeat with a period, by a rule on the id."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", (h % 10 == 0).alias("planted"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("w", F.when(F.col("planted"), F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.expr("(n - a) div (3 + g % 8)"))
    again = F.array_join(F.expr("transform(w, (x, i) -> if(i < a, x, w[int(a + (i - a) % p)]))"), " ")
    return rows.select("doc_id", F.when(F.col("planted") & (F.col("n") > 0), again).otherwise(F.col("text")).alias("text"))


def digested(found: DataFrame) -> DataFrame:
    """The digest columns from the operator's runs and texts."""
    best = F.expr("aggregate(runs, cast(null as struct<start:long,length:long,period:long>), (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(periodic_runs(made_periodic(spark.read.parquet(f"{sf_dir}/documents.parquet"))))

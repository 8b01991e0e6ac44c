"""op1: near-duplicate class of every document."""

from pyspark.sql import DataFrame, SparkSession

from sparrowdoc.llm.minhash import near_duplicates

#: All pairs of texts that share a shingle, and their classes by reachability.
SQL = r"""
WITH RECURSIVE t AS (SELECT coalesce(text, '') AS text, min(doc_id) AS id FROM documents GROUP BY 1),
w AS (SELECT id, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS w FROM t),
g AS (SELECT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
s AS (SELECT id, g, count(*) AS c FROM g GROUP BY ALL), n AS (SELECT id, sum(c) AS n FROM s GROUP BY 1),
p AS (SELECT a.id AS x, b.id AS y, sum(least(a.c, b.c)) AS i FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.id = x JOIN n b ON b.id = y WHERE 5 * i >= 4 * (a.n + b.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT id, id AS root FROM t UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.id),
c AS (SELECT id, min(root) AS class_id FROM r GROUP BY 1)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size FROM documents d JOIN t ON t.text = coalesce(d.text, '') JOIN c USING (id)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), class_size for all `documents`."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

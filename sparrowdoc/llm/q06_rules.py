"""op6: quality rules on every document, with `source` as its host."""

from pyspark.sql import DataFrame, SparkSession

from sparrowdoc.llm.rules import line_rules

SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS w FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM w, unnest(range(1, len(w) - 3)) AS r(i)),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM k, range(0, 5) AS r(j) WHERE k.n > 1 GROUP BY 1),
ln AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT doc_id, host, line, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h, len(regexp_extract_all(line, '[^ \t\n\x0B\f\r]+')) AS n FROM ln WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l GROUP BY 1),
hosts AS (SELECT host, count(DISTINCT doc_id) AS n FROM d GROUP BY 1),
common AS (SELECT host, h FROM (SELECT host, h, count(DISTINCT doc_id) AS n FROM l GROUP BY ALL) f JOIN hosts USING (host) WHERE f.n >= 10 AND f.n > 0.02 * hosts.n),
lost AS (SELECT doc_id, sum(n)::BIGINT AS n FROM l JOIN common USING (host, h) GROUP BY 1),
x AS (SELECT w.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda s: length(s))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS n_common_words FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - n_common_words >= 10 AND n_words - n_common_words >= 0.5 * n_words AS kept, n_common_words FROM b
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))

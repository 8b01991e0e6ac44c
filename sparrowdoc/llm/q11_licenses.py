"""op11: license notices of every document."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowdoc.llm.licenses import ALL, COVER, SEEDS, find_licenses


def _values() -> tuple[str, str]:
    """Notices as rows (k, label, base, words) and their needed positions as rows (k, t)."""
    text = lambda s: f"'{s}'"  # noqa: E731  words and labels have no quotes
    notices = ", ".join(f"({k}, {text(n.label)}, {n.base}, [{', '.join(map(text, n.words()))}])" for k, n in enumerate(ALL))
    needed = ", ".join(f"({k}, {t})" for k, n in enumerate(ALL) for t in n.needed())
    return notices, needed


NOTICES, NEEDED = _values()
SQL = rf"""
WITH p(k, label, base, words) AS (VALUES {NOTICES}), need(k, t) AS (VALUES {NEEDED}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
tw AS (SELECT k, unnest(range(len(words))) AS t, unnest(words) AS w FROM p),
x AS (SELECT doc_id, i, w FROM (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS w FROM d) SEMI JOIN tw USING (w)),
idf AS (SELECT w, 1 + floor(1000 * ln(((SELECT count(*) FROM d) + 1)::DOUBLE / (count(DISTINCT doc_id) + 1)))::BIGINT AS g FROM (SELECT DISTINCT w FROM tw) LEFT JOIN x USING (w) GROUP BY 1),
tg AS (SELECT tw.*, g FROM tw JOIN idf USING (w)), whole AS (SELECT k, sum(g) AS whole FROM tg GROUP BY 1),
here AS (SELECT DISTINCT doc_id, w FROM x), can AS (SELECT doc_id, k FROM here JOIN tg USING (w) JOIN whole USING (k) GROUP BY ALL HAVING 100 * sum(g) >= {COVER} * any_value(whole)),
seed AS (SELECT k, w, count(*) OVER (PARTITION BY k) AS n FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY g DESC, w) AS o FROM (SELECT DISTINCT k, w, g FROM need JOIN tg USING (k, t))) WHERE o <= {SEEDS}),
place AS (SELECT doc_id, k, i - t AS o FROM can JOIN seed USING (k) JOIN x USING (doc_id, w) JOIN (SELECT k, t, w FROM need JOIN tg USING (k, t)) USING (k, w) GROUP BY ALL HAVING count(DISTINCT w) = any_value(n)),
m AS (SELECT doc_id, k, o, sum(g) AS got, count(need.t) AS n FROM place JOIN tg USING (k) JOIN x USING (doc_id, w) LEFT JOIN need ON need.k = place.k AND need.t = tg.t WHERE x.i = o + tg.t GROUP BY ALL),
f AS (SELECT doc_id, label, base, o, got / whole::DOUBLE AS score FROM m JOIN whole USING (k) JOIN (SELECT k, count(*) AS n FROM need GROUP BY 1) q USING (k) JOIN p USING (k) WHERE m.n = q.n AND 100 * got >= {COVER} * whole),
l AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(o) FILTER (base) AS first_word, max(o) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
  max(CASE WHEN base THEN 0.5 ELSE score END) AS score FROM f GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN l USING (doc_id)
"""


def digested(found: DataFrame) -> DataFrame:
    """The columns of the query. score: of the best notice; a plain phrase alone counts as a half."""
    base = F.filter("found", lambda f: f["base"])
    at = F.transform(base, lambda f: f["word"].cast("long"))
    named = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda f: f["label"]))), ",")
    score = F.array_max(F.transform("found", lambda f: F.when(f["base"], F.lit(0.5)).otherwise(f["score"])))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        named(base).alias("base_labels"), named("found").alias("labels"), F.coalesce(score, F.lit(0.0)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")))

"""The pool of evaluation items: what is drawn, and what a changed collection no longer bears out."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparrowdoc.operators import goldpool
from sparrowdoc.plans.catalogue import query

#: Facts, codes, series and unknown terms read from `documents`: a line with source, code, person and year stands after each text.
FACTS = r"""d AS (SELECT doc_id, source, doc_id // 10 % 20 AS k, doc_id % 10 = 0 AS own, 2020 + doc_id // 200 % 4 AS year, coalesce(text, '') AS body FROM documents WHERE length(text) >= 20),
m AS (SELECT *, chr(10) || 'about <' || source || '> code K' || doc_id % 5 || 'Z ' || CASE WHEN own THEN 'by Owner' || k || 'E in ' || year WHEN doc_id % 7 = 0 THEN 'no decision' ELSE '' END AS line FROM d),
f AS (SELECT *, CASE WHEN own THEN 'series' || k ELSE '<' || source || '>' END AS topic, CASE WHEN doc_id % 7 = 0 AND NOT own THEN 'open' WHEN doc_id % 7 = 1 THEN 'overturned' ELSE 'decided' END AS status,
  substr(body, 1, 20) AS key, substr(split_part(body, '.', 1), 1, 60) AS point, CASE WHEN doc_id % 11 = 0 THEN 'scan' WHEN doc_id % 6 = 0 THEN 'table' ELSE 'ordinary' END AS kind, CASE WHEN doc_id % 11 <> 0 AND doc_id % 6 = 0 THEN '<' || source || '>' END AS line_of FROM m),
s AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS nth FROM f WHERE status <> 'open'), o AS (SELECT topic, min('Owner' || k || 'E') AS owner FROM f WHERE own GROUP BY 1),
w AS (SELECT topic FROM f WHERE status = 'decided' AND NOT own GROUP BY 1 HAVING count(*) > 1 ORDER BY count(*) DESC, topic LIMIT 1),
y AS (SELECT topic, year, 'Owner' || any_value(k) || 'E' AS owner, min(doc_id) AS doc_id FROM f WHERE own GROUP BY ALL),
i AS (SELECT 'fact:' || doc_id || ':0' AS item_id, 'fact' AS type, kind, NULL AS anchor, CASE WHEN line_of IS NULL THEN 'What does D' || doc_id || ' say of ' || topic || '?' ELSE 'What does the table of D' || doc_id || ' have for ' || line_of || ' of ' || topic || '?' END AS question, key AS answer FROM s WHERE nth % 2 = 0
  UNION ALL SELECT 'decision:' || doc_id || ':0', 'decision', NULL, NULL, CASE status WHEN 'overturned' THEN 'What is the latest decision about ' ELSE 'What was settled about ' END || topic || ' in D' || doc_id || '?', key FROM s WHERE nth % 2 = 1
  UNION ALL SELECT 'open_discussion:' || doc_id || ':0', 'open_discussion', NULL, NULL, 'Was anything settled about ' || topic || ' in D' || doc_id || '?', 'no decision' FROM f WHERE status = 'open'
  UNION ALL SELECT 'term:K' || c || 'Z', 'term', NULL, NULL, 'Which code stands for group ' || c || '?', 'K' || c || 'Z' FROM range(5) AS r(c)
  UNION ALL SELECT 'cross_doc:' || topic, 'cross_doc', NULL, 'person', 'What was decided about ' || topic || ' over time?', owner FROM o
  UNION ALL SELECT 'cross_doc:topic:' || topic, 'cross_doc', NULL, 'topic', 'What do the documents say about ' || topic || '?', topic FROM w
  UNION ALL SELECT 'time_filter:' || topic || ':' || year, 'time_filter', NULL, NULL, 'What happened with ' || topic || ' in ' || year || '?', owner || ', ' || year FROM y
  UNION ALL SELECT 'no_answer:Term' || c || 'Q', 'no_answer', NULL, NULL, 'What are the rules for Term' || c || 'Q?', 'Not covered by any document.' FROM range(8) AS r(c)),
src AS (SELECT 'fact:' || doc_id || ':0' AS item_id, doc_id FROM s WHERE nth % 2 = 0 UNION ALL SELECT 'decision:' || doc_id || ':0', doc_id FROM s WHERE nth % 2 = 1 UNION ALL SELECT 'open_discussion:' || doc_id || ':0', doc_id FROM f WHERE status = 'open'
  UNION ALL SELECT 'term:K' || doc_id % 5 || 'Z', doc_id FROM f UNION ALL SELECT 'cross_doc:' || topic, doc_id FROM f WHERE own UNION ALL SELECT 'cross_doc:topic:' || w.topic, doc_id FROM f, w WHERE w.topic = '<' || source || '>'
  UNION ALL SELECT 'time_filter:' || topic || ':' || year, doc_id FROM y),
raw AS (SELECT 'cross_doc:' || topic AS item_id, doc_id, point AS phrase FROM f WHERE own UNION ALL SELECT 'cross_doc:topic:' || topic, doc_id, point FROM f JOIN w USING (topic) WHERE status = 'decided' UNION ALL SELECT 'time_filter:' || y.topic || ':' || y.year, y.doc_id, f.point FROM y JOIN f USING (doc_id)),
pts AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY doc_id) <= 8),
ph AS (SELECT item_id, answer AS phrase FROM i WHERE type IN ('fact', 'decision', 'open_discussion', 'term', 'cross_doc') UNION ALL SELECT 'fact:' || doc_id || ':0', line_of FROM s WHERE nth % 2 = 0 AND line_of IS NOT NULL
  UNION ALL SELECT 'time_filter:' || topic || ':' || year, owner FROM y UNION ALL SELECT 'time_filter:' || topic || ':' || year, year::VARCHAR FROM y UNION ALL SELECT item_id, substr(item_id, 11) FROM i WHERE type = 'no_answer')"""  # fmt: skip


def _collection(t):
    """doc_id, body, line (after the body) and the facts' columns."""
    d = t("documents").where("length(text) >= 20").selectExpr("doc_id", "source", "text as body", "doc_id div 10 % 20 as k", "doc_id % 10 = 0 as own", "cast(2020 + doc_id div 200 % 4 as int) as year")
    tail = F.expr("case when own then concat('by Owner', k, 'E in ', year) when doc_id % 7 = 0 then 'no decision' else '' end")
    return d.withColumn("line", F.concat(F.lit("\nabout <"), "source", F.lit("> code K"), F.expr("cast(doc_id % 5 as string)"), F.lit("Z "), tail))


def _pool(spark, rows):
    kind = "case when doc_id % 11 = 0 then 'scan' when doc_id % 6 = 0 then 'table' end"
    facts = rows.selectExpr(
        "doc_id", "0 as fact_no", "concat('D', doc_id) as title", "case when own then concat('series', k) else concat('<', source, '>') end as topic",
        "case when doc_id % 7 = 0 and not own then 'open' when doc_id % 7 = 1 then 'overturned' else 'decided' end as status", "substr(body, 1, 20) as key", "body as text",
        f"{kind} as kind", f"case when {kind} = 'table' then concat('<', source, '>') end as row", "year",
    )
    series = rows.where("own").selectExpr("concat('series', k) as topic", "concat('Owner', k, 'E') as owner", "doc_id")
    codes = spark.range(5).selectExpr("concat('group ', id) as topic", "concat('K', id, 'Z') as code")
    return goldpool.build(facts, codes, series, spark.range(8).selectExpr("concat('Term', id, 'Q') as term"), rows.select("doc_id", F.concat("body", "line").alias("text")))


@query(f"""WITH {FACTS}, q(type, t, quota) AS (VALUES ('fact', 1, 70), ('decision', 2, 46), ('open_discussion', 3, 30), ('term', 4, 5), ('cross_doc', 5, 15), ('time_filter', 6, 24), ('no_answer', 7, 8)),
h AS (SELECT i.*, t, quota, CASE WHEN t <= 3 THEN sha256('42|' || item_id) ELSE question END AS o FROM i JOIN q USING (type)),
l AS (SELECT *, NOT (kind IN ('table', 'scan') AND row_number() OVER (PARTITION BY type, kind ORDER BY o, item_id) <= CASE kind WHEN 'table' THEN 2 ELSE 1 END) IS TRUE AS late FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY late, o, item_id) AS place FROM l), n AS (SELECT *, row_number() OVER (ORDER BY t, place) AS n FROM r WHERE place <= quota)
SELECT printf('g%03d', n) AS item_id, type, question, answer AS expected_answer, type = 'no_answer' AS refusable, (SELECT count(*) FROM src WHERE src.item_id = n.item_id) AS sources,
  (SELECT count(DISTINCT phrase) FROM ph WHERE ph.item_id = n.item_id) AS phrases, (SELECT count(*) FROM pts WHERE pts.item_id = n.item_id) AS points FROM n""")
def gold_pool(spark, t):
    """The full set, drawn from all items that facts of all documents give, with the numbers of its phrases, sources and points."""
    got = goldpool.drawn(_pool(spark, _collection(t)), goldpool.FULL, "g")
    out = got.items.select("item_id", "type", "question", "expected_answer", "refusable")
    for name in ("sources", "phrases", "points"):
        out = out.join(getattr(got, name).groupBy("item_id").agg(F.count("*").alias(name)), "item_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


@query(rf"""WITH {FACTS}, v AS (SELECT doc_id, k, own, body, line, CASE doc_id % 13 WHEN 4 THEN substr(body, 21) ELSE body END || line || CASE WHEN doc_id % 130 = 5 THEN ' Term3Q' WHEN doc_id % 130 = 6 THEN ' Owner4E' ELSE '' END AS text FROM m WHERE doc_id % 13 <> 3),
z AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS t FROM v), ch AS (SELECT doc_id, regexp_replace(CASE WHEN doc_id % 13 IN (4, 7) THEN substr(body, 21) ELSE body END, '\s+', '', 'g') AS t FROM v UNION ALL SELECT doc_id, regexp_replace(line, '\s+', '', 'g') FROM v),
named AS (SELECT item_id, doc_id FROM src UNION SELECT item_id, doc_id FROM pts), gone AS (SELECT item_id, doc_id FROM named ANTI JOIN v USING (doc_id)), ok AS (SELECT * FROM i ANTI JOIN gone USING (item_id)), a AS (SELECT * FROM ok WHERE type <> 'no_answer'),
want AS (SELECT DISTINCT item_id, phrase, doc_id, false AS point FROM ph JOIN src USING (item_id) SEMI JOIN a USING (item_id) UNION ALL SELECT item_id, phrase, doc_id, true FROM pts SEMI JOIN a USING (item_id)),
wf AS (SELECT *, regexp_replace(phrase, '\s+', '', 'g') AS form FROM want),
hit AS (SELECT 'not in text' AS c, wf.* FROM wf JOIN z USING (doc_id) WHERE contains(t, form) UNION ALL SELECT 'not in chunks', wf.* FROM wf JOIN ch USING (doc_id) WHERE contains(t, form)), cs(c) AS (VALUES ('not in text'), ('not in chunks')),
miss AS (SELECT c, item_id, phrase, doc_id FROM wf, cs WHERE point AND NOT EXISTS (FROM hit WHERE hit.c = cs.c AND hit.point AND hit.item_id = wf.item_id AND hit.phrase = wf.phrase AND hit.doc_id = wf.doc_id)
  UNION SELECT c, item_id, phrase, doc_id FROM wf, cs WHERE NOT point AND NOT EXISTS (FROM hit WHERE hit.c = cs.c AND NOT hit.point AND hit.item_id = wf.item_id AND hit.phrase = wf.phrase)),
look AS (SELECT item_id, anchor, answer AS phrase FROM a WHERE anchor IS NOT NULL UNION ALL SELECT item_id, 'nowhere', phrase FROM ph JOIN ok USING (item_id) WHERE type = 'no_answer'),
met AS (SELECT look.*, doc_id FROM look JOIN z ON contains(t, phrase)),
stray AS (SELECT item_id, phrase, doc_id FROM met ANTI JOIN src USING (item_id, doc_id) UNION ALL SELECT item_id, phrase, doc_id FROM look JOIN src USING (item_id) ANTI JOIN met USING (item_id, phrase, doc_id) WHERE anchor = 'topic')
SELECT 'unknown source' AS "check", item_id, NULL AS phrase, min(doc_id) AS doc_id, count(*) AS n FROM gone GROUP BY ALL UNION ALL SELECT c, item_id, phrase, min(doc_id), count(*) FROM miss GROUP BY ALL UNION ALL SELECT 'found elsewhere', item_id, phrase, min(doc_id), count(*) FROM stray GROUP BY ALL""")
def gold_pool_violations(spark, t):
    """The whole pool against a later state: documents gone, heads of texts and of chunks cut, unknown terms and a person's name turning up."""
    rows = _collection(t)
    later = rows.where("doc_id % 13 <> 3")
    head = F.expr("case when doc_id % 13 = 4 then substr(body, 21) else body end")
    more = F.expr("case when doc_id % 130 = 5 then ' Term3Q' when doc_id % 130 = 6 then ' Owner4E' else '' end")
    chunks = later.selectExpr("doc_id", "explode(array(case when doc_id % 13 in (4, 7) then substr(body, 21) else body end, line)) as text")
    return goldpool.violations(_pool(spark, rows), later.select("doc_id", F.concat(head, "line", more).alias("text")), chunks)

"""Intake, text functions, chunks and keyed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparrowdoc.functions import text as T
from sparrowdoc.operators import chunk, metrics, provenance
from sparrowdoc.plans.catalogue import query
from sparrowdoc.sources import readers, tables
from sparrowdoc.sources.shared import Workspace


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS content_id, doc_id <> min(doc_id) OVER (PARTITION BY text) AS is_duplicate FROM documents")
def doc_dedup_hash(spark, t):
    out = tables.first_of_each(t("documents").select("doc_id", "text"), "text", "doc_id")
    return out.select("doc_id", F.col("doc_id_by_content").alias("content_id"), "is_duplicate")


@query("""SELECT source, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars, round(avg(n_chars), 1) AS mean_chars, count(*) FILTER (n_chars < 50) AS suspect,
  count(DISTINCT lang) AS langs FROM documents GROUP BY source""")
def corpus_profile_by_source(spark, t):
    return t("documents").groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.round(F.avg("n_chars"), 1).alias("mean_chars"), F.count_if(F.expr("n_chars < 50")).alias("suspect"), F.countDistinct("lang").alias("langs")
    )


@query("""SELECT doc_id, CASE WHEN n_chars >= 50 THEN 'text' WHEN doc_id % 3 = 0 THEN 'near_empty' WHEN doc_id % 3 = 1 THEN 'ocr_applied' ELSE 'ocr_unavailable' END AS outcome FROM documents""")
def parsing_outcomes(spark, t):
    rows = t("documents").select("doc_id", F.col("n_chars").alias("chars"), F.lit(1).alias("pages"), F.expr("doc_id % 3").alias("images"), F.expr("case when doc_id % 3 = 1 then text end").alias("ocr"))
    return rows.select("doc_id", tables.parsing_outcome("chars", "pages", "images", "ocr").alias("outcome"))


RECONCILE = """WITH s AS (SELECT doc_id, (n_chars + 511) // 512 AS chunks FROM documents), k AS (SELECT DISTINCT doc_id + 10 AS doc_id FROM labels)
SELECT (SELECT count(*) FROM s ANTI JOIN k USING (doc_id)) AS orphans, (SELECT coalesce(sum(chunks), 0)::BIGINT FROM s ANTI JOIN k USING (doc_id)) AS orphan_chunks,
  (SELECT count(*) FROM k ANTI JOIN s USING (doc_id)) AS missing, (SELECT count(*) FROM s) AS stored, (SELECT sum(chunks)::BIGINT FROM s) AS stored_chunks, (SELECT count(*) FROM k) AS kept"""


def _reconciled(t):
    stored = t("documents").select("doc_id", F.expr("(n_chars + 511) div 512").alias("chunks"))
    return provenance.reconcile(stored, t("labels").select((F.col("doc_id") + 10).alias("doc_id")))


@query(RECONCILE)
def reconcile_counts(spark, t):
    return _reconciled(t)[2]


@query("""WITH s AS (SELECT doc_id, (n_chars + 511) // 512 AS chunks FROM documents), k AS (SELECT DISTINCT doc_id + 10 AS doc_id FROM labels)
SELECT doc_id, 'orphan' AS what, chunks FROM s ANTI JOIN k USING (doc_id) UNION ALL SELECT doc_id, 'missing', NULL FROM k ANTI JOIN s USING (doc_id)""")
def reconcile_orphans_missing(spark, t):
    orphans, missing, _ = _reconciled(t)
    return orphans.select("doc_id", F.lit("orphan").alias("what"), "chunks").union(missing.select("doc_id", F.lit("missing"), F.lit(None).cast("long")))


@query(f"WITH c AS ({RECONCILE}) SELECT orphans, kept, CASE WHEN orphans = 0 THEN 'nothing' WHEN orphans > kept THEN 'refuse: too many' ELSE 'delete' END AS decision FROM c")
def prune_gate(spark, t):
    return provenance.prune_decision(_reconciled(t)[2], F.lit(True), F.lit(0)).select("orphans", "kept", "decision")


@query("""SELECT doc_id, lang, n_chars FROM documents ANTI JOIN labels USING (doc_id) UNION ALL
SELECT doc_id, 'label' AS lang, quality::BIGINT AS n_chars FROM labels""")
def upsert_replace_docs(spark, t):
    incoming = t("labels").select("doc_id", F.lit("label").alias("lang"), F.col("quality").cast("long").alias("n_chars"))
    return tables.upserted(t("documents").select("doc_id", "lang", "n_chars"), incoming, "doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_docs(spark, t):
    return tables.deleted(t("documents").select("doc_id", "source"), t("labels").where("toxic = 1"), "doc_id")


@query("SELECT d.doc_id, coalesce(CASE WHEN l.quality = 0 THEN 'poor' END, d.lang) AS lang FROM documents d LEFT JOIN labels l USING (doc_id)")
def backfill_metadata(spark, t):
    values = t("labels").select("doc_id", F.expr("case when quality = 0 then 'poor' end").alias("lang"))
    return tables.backfilled(t("documents").select("doc_id", "lang"), values, "doc_id", ["lang"])


TOKENS = r"SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents"


@query(f"WITH k AS ({TOKENS}) SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM k GROUP BY term")
def token_frequency(spark, t):
    own = t("documents").select("doc_id", F.explode(T.tokens("text")).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    return own.groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


@query(r"""SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS n_terms FROM documents""")
def document_tokens(spark, t):
    k = T.tokens("text")
    return t("documents").select("doc_id", F.size(k).cast("long").alias("n_tokens"), F.size(F.array_distinct(k)).cast("long").alias("n_terms"))


@query(r"""SELECT doc_id, len(list_filter(regexp_extract_all(text, '[^.!?;' || chr(10) || ']*[.!?;' || chr(10) || ']|[^.!?;' || chr(10) || ']+'), lambda s: regexp_replace(s, '\s+', '', 'g') <> '')) AS n_sentences FROM documents""")
def sentence_counts(spark, t):
    return t("documents").select("doc_id", F.size(T.sentences("text", ".!?;\n")).cast("long").alias("n_sentences"))


@query(r"""SELECT doc_id, md5(regexp_replace(text, '[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x0b]+', '', 'g')) AS squeezed,
  length(translate(regexp_replace(text, '[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x0b]+', '', 'g'), '@_\*', '')) AS phrase_chars FROM documents""")
def text_normal_forms(spark, t):
    return t("documents").select("doc_id", F.md5(T.squeeze("text")).alias("squeezed"), F.length(T.phrase_form("text")).cast("long").alias("phrase_chars"))


CHUNKS = """SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start))::INTEGER AS chunk_no, start, chunk FROM (
  SELECT doc_id, text, start::INTEGER AS start, substr(text, start + 1, 512) AS chunk, length(text) AS n,
    min(CASE WHEN start + 512 >= length(text) AND regexp_matches(substr(text, start + 1, 512), '\\S') THEN start END) OVER (PARTITION BY doc_id) AS stop
  FROM (SELECT doc_id, text, unnest(range(0, length(text), 448)) AS start FROM documents WHERE length(text) > 0))
  WHERE regexp_matches(chunk, '\\S') AND (start + 512 < n OR start = stop)"""


@query(f"WITH c AS ({CHUNKS}) SELECT doc_id, chunk_no, start, md5(chunk) AS chunk_md5 FROM c")
def chunk_fixed(spark, t):
    return chunk.chunk_by("fixed", t("documents")).select("doc_id", "chunk_no", "start", F.md5("chunk").alias("chunk_md5"))


@query()
def chunk_structural(spark, t):
    """Structural chunks of documents as paragraphs: a fold that SQL can't say; tests hold it against worked cases."""
    return chunk.chunk_by("structural", t("documents"), ends=".!?;\n").select("doc_id", "chunk_no", F.length("text").alias("n_chars"), "block_type")


@query(r"""WITH c AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<head>.*?</head>|<nav>.*?</nav>', '', 'g') AS h FROM pages),
p AS (SELECT page_id, unnest(string_split(regexp_replace(h, '<(h[1-6]|p|li|div|article|footer|body)[^>]*>', chr(1) || '\1' || chr(2), 'g'), chr(1))) AS part FROM c),
b AS (SELECT page_id, regexp_extract(part, '^([a-z]+[1-6]?)' || chr(2), 1) AS tag,
  trim(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(part, '^[a-z]+[1-6]?' || chr(2), ''), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) AS text FROM p)
SELECT page_id, count(*) AS n_blocks, count(*) FILTER (regexp_matches(tag, '^h[1-6]$')) AS n_headings, sum(length(text))::BIGINT AS n_chars FROM b WHERE text <> '' GROUP BY page_id""")
def html_blocks(spark, t):
    out = chunk.html_blocks(t("pages"))
    return out.groupBy("page_id").agg(F.count("*").alias("n_blocks"), F.count_if(F.expr("type = 'heading'")).alias("n_headings"), F.sum(F.length("text")).alias("n_chars"))


@query("""SELECT s_suppkey AS doc_id, s_name AS label, s_acctbal::VARCHAR AS value FROM supplier""")
def table_numeric_pairs(spark, t):
    made = F.concat_ws("\n", F.lit("| name | balance |"), F.lit("|---|---|"), F.concat(F.lit("| "), "s_name", F.lit(" | √ | "), F.col("s_acctbal").cast("string"), F.lit(" |")))
    rows = t("supplier").select(F.col("s_suppkey").alias("doc_id"), F.explode(T.table_rows(made)).alias("c"))
    return rows.select("doc_id", F.get("c", F.lit(0)).alias("label"), T.first_number(F.col("c")).alias("value")).where("value is not null")


@query("""SELECT p_partkey AS doc_id, 3::BIGINT AS n_blocks, p_name AS heading, p_brand || chr(10) || p_type AS body FROM part""")
def markdown_blocks(spark, t):
    made = F.concat_ws("\n", F.concat(F.lit("## "), "p_name"), F.lit(""), F.concat(F.lit("- "), "p_brand"), F.col("p_type"), F.lit(""), F.concat(F.lit("|"), F.col("p_size").cast("string"), F.lit("|")))
    out = chunk.markdown_blocks(t("part").select(F.col("p_partkey").alias("doc_id"), made.alias("text")))
    return out.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.max(F.when(F.col("type") == "heading", F.col("text"))).alias("heading"), F.max(F.when(F.col("type") == "paragraph", F.col("text"))).alias("body"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS in_name, strftime(o_orderdate, '%Y-%m-%d') AS in_text, 'orders' AS category,
  'g' || (o_orderkey % 7) AS doc_group, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y') END AS period FROM orders WHERE year(o_orderdate) >= 2000""")
def title_metadata(spark, t):
    group = F.concat(F.lit("g"), (F.col("o_orderkey") % 7).cast("string"))
    rows = t("orders").where("year(o_orderdate) >= 2000").select(
        "o_orderkey", F.concat_ws("_", F.lit("orders"), group, F.date_format("o_orderdate", "yyyy年M月d日")).alias("title"),
        F.concat(F.lit("held on "), F.date_format("o_orderdate", "yyyy . M . d")).alias("text"), F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy年M月")).otherwise(F.date_format("o_orderdate", "yyyy年")).alias("when_"),
    )
    return rows.select("o_orderkey", T.date_in_name("title").alias("in_name"), T.date_in_text("text").alias("in_text"), T.title_category("title").alias("category"), T.title_group("title").alias("doc_group"), T.title_period("when_").alias("period"))


@query("""WITH w AS (SELECT DISTINCT 2000 + o_orderkey % 40 AS y, 1 + o_orderkey % 54 AS w FROM orders),
m AS (SELECT y, w, (date_trunc('week', make_date(y, 1, 4)) + to_days(((w - 1) * 7)::INTEGER))::DATE AS d FROM w)
SELECT y, w, CASE WHEN w > 53 THEN NULL WHEN isoyear(d) <> y THEN y || '-12-31' WHEN year(d) < y THEN y || '-01-01' ELSE strftime(d, '%Y-%m-%d') END AS monday FROM m""")
def week_dates(spark, t):
    rows = t("orders").select((2000 + F.col("o_orderkey") % 40).alias("y"), (1 + F.col("o_orderkey") % 54).alias("w")).distinct()
    return rows.select("y", "w", T.week_in_name(F.format_string("x%d年第%d周", "y", "w")).alias("monday"))


@query("""SELECT doc_id, substr(sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(doc_id || ':1')), 1, 8) AS uuid_head, len(list_filter([doc_id % 4, doc_id % 4 + 2], lambda i: i >= 1)) AS n_neighbours FROM documents""")
def chunk_ids(spark, t):
    rows = t("documents").select("doc_id", T.name_uuid(F.concat(F.col("doc_id").cast("string"), F.lit(":1"))).alias("u"), F.concat(F.lit("d:"), (F.col("doc_id") % 4 + 1).cast("string")).alias("c"))
    return rows.select("doc_id", F.substring("u", 1, 8).alias("uuid_head"), F.size(T.neighbours("c")).cast("long").alias("n_neighbours"))


@query("""SELECT count(*) AS documents, sum(length(text))::BIGINT AS characters,
  substr(sha256('v1' || chr(10) || 'characters="' || sum(length(text))::BIGINT || '"' || chr(10) || 'documents="' || count(*) || '"' || chr(10) || 'total="' ||
    sum(('0x' || substr(sha256(doc_id || chr(10) || sha256(text)), 1, 12))::BIGINT)::HUGEINT || '"'), 1, 16) AS fingerprint FROM documents""")
def fingerprint(spark, t):
    return provenance.corpus_fingerprint(t("documents"))


@query("""WITH done AS (SELECT doc_id, quality, toxic = 1 AS failed FROM labels)
SELECT 'reuse' AS what, count(*) AS n FROM done WHERE NOT failed AND doc_id IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'todo', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM done WHERE NOT failed)""")
def resume_todo(spark, t):
    reuse, todo = provenance.resume(t("documents").select("doc_id"), t("labels"), "doc_id", F.col("toxic") == 1)
    return reuse.agg(F.lit("reuse").alias("what"), F.count("*").alias("n")).union(todo.agg(F.lit("todo"), F.count("*")))


@query(r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents), n AS (SELECT doc_id, length(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS n FROM p), a AS (SELECT doc_id AS file, count(*) AS pages, round(sum(n) / count(*), 1) AS chars_per_page, count(*) FILTER (n < 20) AS near_empty_pages, (count(*) * (doc_id % 3))::BIGINT AS images FROM n GROUP BY doc_id)
SELECT *, chars_per_page < 50 AS scan_suspect, chars_per_page < 50 AND images > 0 AS scan_likely, chars_per_page < 50 AND images = 0 AS near_empty FROM a""")
def page_profile(spark, t):
    """Each line of a document as a page, with some images."""
    pages = t("documents").select(F.col("doc_id").alias("file"), F.explode(F.split("text", "\n")).alias("text"), F.expr("doc_id % 3").alias("images"))
    return tables.page_profile(pages)


@query("""WITH f AS (SELECT 'raw/' || CASE WHEN doc_id % 17 = 0 THEN '.' ELSE '' END || 'd' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.pdf' ELSE '' END AS p, doc_id FROM documents)
SELECT CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.pdf' ELSE 'none' END AS suffix, count(*) AS files FROM f WHERE doc_id % 17 <> 0 GROUP BY 1""")
def suffix_counts(spark, t):
    path = F.expr("concat('raw/', case when doc_id % 17 = 0 then '.' else '' end, 'd', doc_id, case doc_id % 4 when 0 then '.PDF' when 1 then '.docx' when 2 then '.pdf' else '' end)")
    return tables.suffix_counts(t("documents").select(path.alias("path")))


@query("""WITH o AS (SELECT CASE WHEN n_chars >= 50 THEN 'text' WHEN doc_id % 3 = 0 THEN 'near_empty' WHEN doc_id % 3 = 1 THEN 'ocr_applied' ELSE 'ocr_unavailable' END AS outcome, lpad(doc_id::VARCHAR, 9, '0') AS name FROM documents)
SELECT outcome, count(*) OVER (PARTITION BY outcome) AS n, row_number() OVER (PARTITION BY outcome ORDER BY name) AS no, name FROM o""")
def outcome_names(spark, t):
    rows = t("documents").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("name"), F.col("n_chars").alias("chars"), F.lit(1).alias("pages"), F.expr("doc_id % 3").alias("images"), F.expr("case when doc_id % 3 = 1 then text end").alias("ocr"))
    return tables.outcomes_with_names(rows.withColumn("outcome", tables.parsing_outcome("chars", "pages", "images", "ocr")), "outcome", "name")


@query(r"""SELECT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, count(*) AS pages FROM pages GROUP BY 1""")
def page_hosts(spark, t):
    return t("pages").groupBy(T.url_host("url").alias("host")).agg(F.count("*").alias("pages"))


@query("""SELECT o_orderstatus, count(*) AS n, count(*) FILTER (year(o_orderdate) >= 1995) AS dated, round(count(*) FILTER (year(o_orderdate) >= 1995) / count(*), 4) AS coverage FROM orders GROUP BY 1""")
def date_coverage(spark, t):
    return metrics.date_coverage(t("orders"), "o_orderstatus", "o_orderdate", 1995)


@query("""WITH e AS (SELECT 'k' || user_id AS key, event_type AS model, value, ts, event_id FROM events), p AS (SELECT key, arg_max(struct_pack(model, value), event_id) AS m FROM e GROUP BY 1),
c AS (SELECT key, m.model AS model, m.value AS value FROM p WHERE m.model IS DISTINCT FROM 'click'), a AS (SELECT DISTINCT 'k' || (user_id + 3) AS key FROM events) SELECT key, model, value, c.key IS NOT NULL AS hit FROM a LEFT JOIN c USING (key)""")
def cache_replay(spark, t):
    """Answers put one after another, a model cleared, keys asked for."""
    e = t("events").select(F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key"), F.col("event_type").alias("model"), "value", F.col("event_id").alias("at"))
    cache = tables.cache_put(e.where("false"), e.where("at % 2 = 0"))
    cache = tables.cache_put(cache, e.where("at % 2 = 1").union(cache))
    asked = t("events").select(F.concat(F.lit("k"), (F.col("user_id") + 3).cast("string")).alias("key")).distinct()
    return tables.cache_get(tables.cache_clear(cache, "click"), asked).select("key", "model", "value", "hit")


#: A parsed document of each row: some cut off, without blocks, named as the profile, without an id, or with blocks without text.
FILES = """case doc_id % 10 when 0 then substr(j, 1, length(j) - 3) when 1 then concat('{"meta":{"doc_id":"d', doc_id, '"},"blocks":[]}') when 3 then replace(j, '"doc_id"', '"other"') else j end"""
LONG = "len(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) >= 120"


@query(f"""WITH d AS (SELECT doc_id % 10 AS k, {LONG} AS long FROM documents),
v AS (SELECT 'index' AS reader, CASE WHEN k = 2 THEN 'skipped' WHEN k IN (0, 3) THEN 'failed' WHEN k = 1 THEN 'empty' ELSE 'read' END AS outcome FROM d
  UNION ALL SELECT 'items', CASE WHEN k IN (0, 1, 2) OR NOT long THEN 'skipped' WHEN k = 3 THEN 'failed' ELSE 'read' END FROM d
  UNION ALL SELECT 'census', CASE WHEN k = 0 THEN 'skipped' ELSE 'read' END FROM d)
SELECT reader, count(*) AS files, count(*) FILTER (outcome = 'read') AS read, count(*) FILTER (outcome = 'empty') AS empty, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'failed') AS failed FROM v GROUP BY 1""")
def reader_counts(spark, t):
    """What the three readers of parsed documents make of the same files."""
    block = F.array(F.struct(F.lit("paragraph").alias("type"), F.col("text")), F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")))
    j = F.to_json(F.struct(F.struct(F.concat(F.lit("d"), F.col("doc_id")).alias("doc_id")).alias("meta"), block.alias("blocks")))
    rows = t("documents").select("doc_id", j.alias("j"))
    files = rows.select(F.expr("if(doc_id % 10 = 2, 'profile.json', concat(doc_id, '.json'))").alias("file"), F.expr(FILES).cast("binary").alias("content"))
    out = None
    for reader in ("index", "items", "census"):
        own = readers.counts(readers.parsed_documents(files, reader)).withColumn("reader", F.lit(reader))
        out = own if out is None else out.union(own)
    return out


@query("""SELECT CASE WHEN doc_id % 13 = 0 THEN 'failed' WHEN doc_id % 17 = 0 THEN 'skipped' WHEN doc_id % 19 = 0 THEN 'failed' ELSE 'read' END AS outcome,
  CASE WHEN doc_id % 13 = 0 THEN 'no JSON object' WHEN doc_id % 17 = 0 THEN 'blank' WHEN doc_id % 19 = 0 THEN 'no id' END AS error, count(*) AS lines, sum(CASE WHEN doc_id % 13 <> 0 AND doc_id % 17 <> 0 AND doc_id % 19 <> 0 THEN n_chars END)::BIGINT AS n_chars FROM documents GROUP BY ALL""")
def json_line_outcomes(spark, t):
    """Lines written from the documents, some cut off, blank or without an id, and what became of them."""
    j = F.to_json(F.struct(F.expr("if(doc_id % 19 = 0, null, doc_id)").alias("id"), "text", "n_chars"))
    line = F.when(F.col("doc_id") % 13 == 0, F.expr("substr(j, 1, length(j) - 1)")).when(F.col("doc_id") % 17 == 0, F.lit(" \t")).otherwise(F.col("j"))
    path = Workspace(spark).path("lines")
    t("documents").withColumn("j", j).select(line.alias("value")).write.text(path)
    lines = readers.json_lines(spark, path, "id long, text string, n_chars long", needed=("id", "text"))
    return lines.groupBy("outcome", "error").agg(F.count("*").alias("lines"), F.sum("record.n_chars").alias("n_chars"))


@query(r"""WITH g AS (SELECT source, lang, count(*) AS n, min(doc_id) AS first, min(text) AS least FROM documents GROUP BY ALL)
SELECT source, lang, substr(sha256('{"a_first": ' || first || ', "text": ' || '"' || replace(replace(replace(replace(substr(least, 1, 40), chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't') || '"' || ', "z": {"lang": "' || lang || '", "n": ' || n || '}}'), 1, 16) AS state FROM g""")
def state_fingerprints(spark, t):
    """Fingerprints of nested values as JSON with sorted keys."""
    g = t("documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("a_first"), F.substring(F.min("text"), 1, 40).alias("text"))
    g = g.withColumn("z", F.struct("n", "lang"))
    return g.select("source", "lang", provenance.state_fingerprint(g, "z", "text", "a_first").alias("state"))

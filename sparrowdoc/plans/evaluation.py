"""Rank metrics, answer metrics, paired statistics, agreement and the robustness benchmark."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparrowdoc.functions import text as T
from sparrowdoc.operators import metrics as M
from sparrowdoc.operators import places, retrieve, robustness, stats
from sparrowdoc.plans.catalogue import query
from sparrowdoc.plans.retrieval import DENSE, dense_results


def _by_label(t, results):
    """The rank metrics of results whose gold is the rows of a query's label, without itself."""
    e = t("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("class"))
    asked = e.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    return M.class_rank_metrics(results.withColumnRenamed("vec_id", "doc_id"), asked, e)


def _per_query(t, half=False):
    return _by_label(t, dense_results(t, 10, half))


PER_QUERY = """g AS (SELECT q.vec_id AS query_id, v.vec_id FROM q JOIN v ON q.label = v.label AND q.vec_id <> v.vec_id), ng AS (SELECT query_id, count(*) AS n_gold FROM g GROUP BY 1),
h AS (SELECT r.*, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM r JOIN g USING (query_id, vec_id) WHERE rank <= 10),
ls AS (SELECT query_id, count(*) AS n_list FROM r WHERE rank <= 10 GROUP BY 1),
x AS (SELECT query_id, min(rank) AS first_hit, count(*) AS n_hits, count(*) FILTER (rank <= 5) AS hk, sum(so_far::DOUBLE / rank) FILTER (rank <= 5) AS aps,
  sum(1 / log2(rank + 1)) FILTER (rank <= 5) AS d5, sum(1 / log2(rank + 1)) FILTER (rank <= 8) AS d8 FROM h GROUP BY 1),
pq AS (SELECT query_id, n_gold, n_list, first_hit, round(coalesce(hk, 0) / n_gold, 4) AS recall_at_k, round(coalesce(hk, 0) / 5, 4) AS precision_at_k, round(coalesce(aps, 0) / least(n_gold, 5), 4) AS ap_at_k,
  round(coalesce(d5, 0) / list_sum(list_transform(range(1, least(n_gold, 5) + 1), lambda i: 1 / log2(i + 1))), 4) AS ndcg_at_k,
  round(coalesce(d8, 0) / list_sum(list_transform(range(1, least(n_gold, 8) + 1), lambda i: 1 / log2(i + 1))), 4) AS ndcg_at_wide,
  round(coalesce(n_hits, 0) / n_gold, 4) AS recall_at_list, round(least(n_gold, n_list) / n_gold, 4) AS ceiling, round(coalesce(n_hits, 0) / n_gold / (least(n_gold, n_list) / n_gold), 4) AS recall_vs_ceiling
  FROM ng LEFT JOIN ls USING (query_id) LEFT JOIN x USING (query_id))"""
MEANS = ", ".join(f"round(avg({c}), 4) AS mean_{c}" for c in ("recall_at_k", "precision_at_k", "ap_at_k", "ndcg_at_k", "recall_at_list", "ceiling", "recall_vs_ceiling"))
SUMMARY = f"""count(*) AS n, round(avg((coalesce(first_hit, 99) <= 5)::INTEGER), 4) AS hit_at_k, round(avg((coalesce(first_hit, 99) <= 8)::INTEGER), 4) AS hit_at_wide, round(avg((first_hit IS NOT NULL)::INTEGER), 4) AS hit_at_list,
  round(avg(coalesce(1.0::DOUBLE / first_hit, 0)), 4) AS mrr, {MEANS}, min(n_list) AS shortest_list, max(n_list) AS longest_list"""


@query(f"WITH {DENSE}, {PER_QUERY} SELECT * FROM pq")
def rank_metrics_per_query(spark, t):
    return _per_query(t)


@query(f"WITH {DENSE}, {PER_QUERY} SELECT {SUMMARY} FROM pq")
def rank_metrics_summary(spark, t):
    return M.retrieval_summary(_per_query(t))


@query(f"WITH {DENSE}, {PER_QUERY} SELECT label, {SUMMARY} FROM pq JOIN q ON vec_id = query_id GROUP BY label")
def rank_metrics_by_type(spark, t):
    return M.retrieval_summary(_per_query(t).join(t("embeddings").select(F.col("vec_id").alias("query_id"), "label"), "query_id"), ["label"])


@query(f"WITH {DENSE}, {PER_QUERY}, m AS (SELECT label, avg(ndcg_at_k) AS m FROM pq JOIN q ON vec_id = query_id GROUP BY 1) SELECT count(*) AS n_types, round(avg(m), 4) AS macro_mean FROM m")
def rank_metrics_macro(spark, t):
    return M.macro_mean(_per_query(t).join(t("embeddings").select(F.col("vec_id").alias("query_id"), "label"), "query_id"), "label", "ndcg_at_k")


# -- answers: conversations' assistant turns, given marks that the data lacks -------------------------------------------------

ANSWERS = """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' WHEN conv_id % 5 = 0 THEN '根据现有文档无法回答' ELSE text || ' [' || turn || '][' || (conv_id % 4) || ']' END AS answer,
  conv_id % 2 = 0 AS refusable, 3 AS n_contexts FROM conversations WHERE role <> 'system'"""


def _answers(t):
    mark = F.expr("case when turn % 3 = 0 then '' when conv_id % 5 = 0 then '根据现有文档无法回答' else concat(text, ' [', turn, '][', conv_id % 4, ']') end")
    return t("conversations").where("role <> 'system'").select("conv_id", "turn", mark.alias("answer"), F.expr("conv_id % 2 = 0").alias("refusable"), F.lit(3).alias("n_contexts"))


@query(f"""WITH a AS ({ANSWERS}), c AS (SELECT *, answer <> '' AS answered, contains(answer, '无法回答') OR contains(answer, '根据现有文档') AS refused, conv_id % 4 BETWEEN 1 AND 3 AND turn BETWEEN 1 AND 3 AS valid, conv_id % 5 <> 0 AS cited FROM a)
SELECT count(*) AS n, count(*) FILTER (refusable AND answered) AS n_refusable, round(avg(CASE WHEN refusable AND answered THEN refused::INTEGER END), 4) AS refusal_ok, round(avg(CASE WHEN NOT refusable AND answered THEN refused::INTEGER END), 4) AS over_refusal,
  round(avg(CASE WHEN answered THEN cited::INTEGER END), 4) AS citation_present, round(avg(CASE WHEN answered AND cited THEN valid::INTEGER END), 4) AS citation_valid FROM c""")
def refusal_and_citation_rates(spark, t):
    own = M.answer_checks(_answers(t))
    rate = lambda c: F.round(M.share(F.col(c)), 4)
    return own.agg(F.count("*").alias("n"), F.count("refusal_ok").alias("n_refusable"), rate("refusal_ok").alias("refusal_ok"), rate("over_refused").alias("over_refusal"), rate("citation_present").alias("citation_present"), rate("citation_valid").alias("citation_valid"))


@query(r"""WITH w AS (SELECT item_id, list_transform([substr(text, 1, 20), substr(text, 41, 20)], lambda s: regexp_replace(s, '\s+', '', 'g')) AS must FROM benchmark),
n AS (SELECT doc_id, lang, regexp_replace(text, '\s+', '', 'g') AS s FROM documents)
SELECT item_id, count(*) FILTER (contains(s, must[1]) AND contains(s, must[2])) AS strict, count(*) FILTER (contains(s, must[1]) OR contains(s, must[2])) AS any_of FROM w, n GROUP BY item_id""")
def must_contain_strict(spark, t):
    """Answers that hold both key phrases of an item; documents stand for the answers to each item."""
    items = t("benchmark").select("item_id", F.expr("array(substr(text, 1, 20), substr(text, 41, 20))").alias("must"))
    one = items.select("item_id", F.posexplode("must").alias("i", "phrase")).select((F.col("item_id") * 2 + F.col("i")).alias("key"), T.squeeze("phrase").alias("phrase"))
    texts = t("documents").select("doc_id", T.squeeze("text").alias("text"))
    hits = _grams_contain(texts, one).groupBy(F.expr("key div 2").alias("item_id"), "doc_id").agg(F.count("*").alias("n"))
    counts = hits.groupBy("item_id").agg(F.count_if(F.expr("n = 2")).alias("strict"), F.count("*").alias("any_of"))
    return items.select("item_id").join(counts, "item_id", "left").select("item_id", F.coalesce("strict", F.lit(0)).cast("long").alias("strict"), F.coalesce("any_of", F.lit(0)).cast("long").alias("any_of"))


def _grams_contain(texts, asked):
    """(key, doc_id) of texts (doc_id, text) that contain a phrase (key, phrase)."""
    return retrieve.holding(texts, asked, "doc_id", "text", "phrase").join(asked, "phrase").select("key", "doc_id").distinct()


@query(r"""SELECT conv_id, turn, regexp_matches(regexp_replace(text, '\s+', '', 'g'), '(?s)t.*h.*e.*o.*n') AS holds FROM conversations""")
def subsequence_match(spark, t):
    return t("conversations").select("conv_id", "turn", T.holds_in_order(F.lit("t h eon"), "text").alias("holds"))


@query(r"""WITH p AS (SELECT item_id, i, substr(text, 1 + 30 * i, 30) AS phrase FROM benchmark, range(0, 4) AS r(i) WHERE length(text) >= 30 * (i + 1)),
d AS (SELECT string_agg(text, chr(10) ORDER BY doc_id) AS t FROM documents), h AS (SELECT item_id, contains(t, phrase) AS hit FROM p, d)
SELECT item_id, count(*) AS k, count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit) / count(*), 4) AS keypoint_recall,
  CASE WHEN count(*) FILTER (hit) >= ceil(count(*) * 4 / 5) THEN 'full' WHEN count(*) FILTER (hit) > 0 THEN 'half' ELSE 'zero' END AS grade FROM h GROUP BY item_id""")
def keypoint_recall_grade(spark, t):
    points = t("benchmark").select("item_id", "text", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).where(F.length("text") >= 30 * (F.col("i") + 1))
    points = points.select("item_id", (F.col("item_id") * 4 + F.col("i")).alias("key"), F.substring("text", 1 + 30 * F.col("i"), F.lit(30)).alias("phrase"))
    found = _grams_contain(t("documents").select("doc_id", "text"), points.select("key", "phrase")).select("key").distinct().withColumn("hit", F.lit(True))
    return M.keypoint_grades(points.join(found, "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False))), ["item_id"])


@query("""WITH r AS (SELECT conv_id % 3 = 0 AS expected, turn % 2 = 0 AS predicted, role <> 'system' AS usable FROM conversations)
SELECT count(*) FILTER (usable AND expected) AS expected, count(*) FILTER (usable AND NOT expected) AS not_expected, count(*) FILTER (NOT usable) AS left_out,
  round(count(*) FILTER (usable AND expected AND predicted) / nullif(count(*) FILTER (usable AND expected), 0), 4) AS recall, round(count(*) FILTER (usable AND NOT expected AND predicted) / nullif(count(*) FILTER (usable AND NOT expected), 0), 4) AS false_trigger, false AS passes FROM r""")
def routing_gate(spark, t):
    return M.gate(M.routing(t("conversations"), F.expr("conv_id % 3 = 0"), F.expr("turn % 2 = 0"), F.expr("role <> 'system'")))


@query("""WITH r AS (SELECT d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)), x AS (SELECT lang, count(*) AS n, count(*) FILTER (quality IS NULL) AS missing FROM r GROUP BY 1
UNION ALL SELECT 'all', count(*), count(*) FILTER (quality IS NULL) FROM r) SELECT lang, n, missing, round(missing / n, 4) AS rate, missing > 0.2 * n AND (lang = 'all' OR n >= 5) AS rejected FROM x""")
def missing_rate_audit(spark, t):
    return M.missing_audit(t("documents").join(t("labels").select("doc_id", "quality"), "doc_id", "left"), "lang", "quality")


# -- two arms: whole and half vectors ------------------------------------------------------------------------------------------

HALF = DENSE.replace("list_transform(embedding,", "list_transform(embedding[1:32],")
ARMS = f"""a AS (WITH {DENSE}, {PER_QUERY} SELECT query_id, ap_at_k, ndcg_at_k, recall_at_k, n_list FROM pq), b AS (WITH {HALF}, {PER_QUERY} SELECT query_id, ap_at_k, ndcg_at_k, recall_at_k, n_list FROM pq),
lo AS (SELECT query_id AS item_id, test, score FROM a UNPIVOT (score FOR test IN (ap_at_k, ndcg_at_k, recall_at_k))), hi AS (SELECT query_id AS item_id, test, score FROM b UNPIVOT (score FOR test IN (ap_at_k, ndcg_at_k, recall_at_k))),
p AS (SELECT item_id, test, lo.score AS base, hi.score AS other, hi.score - lo.score AS diff FROM lo JOIN hi USING (item_id, test)),
d AS (SELECT test, count(*) AS n, round(avg(base), 4) AS mean_base, round(avg(other), 4) AS mean_other, round(avg(diff), 4) AS mean_diff, count(*) FILTER (diff > 1e-9) AS wins, count(*) FILTER (diff < -1e-9) AS losses, count(*) FILTER (abs(diff) <= 1e-9) AS ties FROM p GROUP BY test)"""
TESTS = ("ap_at_k", "ndcg_at_k", "recall_at_k")


def _pairs(t):
    def long(half):
        return _per_query(t, half).withColumnRenamed("query_id", "item_id").unpivot(["item_id"], list(TESTS), "test", "score").withColumn("key", F.concat_ws("|", "item_id", "test"))

    base, other = long(False), long(True)
    return stats.paired(base, other, "key").join(base.select("key", "item_id", "test"), "key")


@query(f"WITH {ARMS} SELECT * FROM d")
def paired_diff(spark, t):
    return stats.difference(_pairs(t), ["test"])


#: The tail of the binomial by its terms' logarithms.
SIGN = "CASE WHEN wins + losses = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * list_sum(list_transform(range(0, least(wins, losses) + 1), lambda i: exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2))))) END"


@query(f"WITH {ARMS} SELECT test, wins, losses, round({SIGN}, 6) AS p FROM d")
def sign_test(spark, t):
    return stats.difference(_pairs(t), ["test"]).select("test", "wins", "losses", F.round(stats.sign_p(F.col("wins"), F.col("losses")), 6).alias("p"))


@query(f"""WITH {ARMS}, s AS (SELECT test, round({SIGN}, 6) AS p FROM d), o AS (SELECT *, count(*) OVER () AS family_size, row_number() OVER (ORDER BY p, test) - 1 AS i FROM s),
h AS (SELECT *, round(max(least(1.0, (family_size - i) * p)) OVER (ORDER BY i), 6) AS p_holm FROM o) SELECT test, p, family_size, p_holm, p_holm < 0.05 AS significant FROM h""")
def holm_adjust(spark, t):
    own = stats.difference(_pairs(t), ["test"]).select("test", F.round(stats.sign_p(F.col("wins"), F.col("losses")), 6).alias("p"))
    return stats.holm(own).select("test", "p", "family_size", "p_holm", "significant")


@query(f"""WITH {ARMS}, o AS (SELECT *, row_number() OVER (ORDER BY item_id) AS i, count(*) OVER () AS total FROM p WHERE test = 'ap_at_k'), z AS (SELECT o.*, size FROM o, (SELECT 5 AS size UNION SELECT 8 UNION SELECT max(total) FROM o))
SELECT size::INTEGER AS size, count(*) AS n, round(avg(diff), 4) AS mean_diff FROM z WHERE i <= size GROUP BY size""")
def subset_sensitivity(spark, t):
    return stats.prefix_means(_pairs(t).where("test = 'ap_at_k'"), (5, 8)).distinct()


@query(f"""WITH {ARMS}, c AS (SELECT * FROM lo UNION ALL SELECT * FROM hi), m AS (SELECT 'x' AS k, test, avg(score) AS m FROM lo GROUP BY 2 UNION ALL SELECT 'y', test, avg(score) FROM hi GROUP BY 2)
SELECT test, round(max(m) - min(m), 4) AS span FROM m GROUP BY test""")
def repeat_span(spark, t):
    pairs = _pairs(t)
    means = pairs.groupBy("test").agg(F.avg("base").alias("a"), F.avg("other").alias("b"))
    runs = means.select("test", F.lit("a").alias("run"), F.col("a").alias("m")).union(means.select("test", F.lit("b"), "b"))
    return M.repeat_spans(runs, "run", "test", "m")


@query("""WITH r AS (SELECT user_id % 2 AS arm, event_id % 3 AS run_id, user_id AS item_id, avg(value) AS score FROM events GROUP BY ALL), i AS (SELECT arm, item_id, avg(score) AS score FROM r GROUP BY ALL),
m AS (SELECT arm, run_id, avg(score) AS m FROM r GROUP BY ALL), n AS (SELECT arm, count(*) AS runs, round(max(m) - min(m), 6) AS noise_range FROM m GROUP BY 1)
SELECT arm, runs, noise_range, count(*) AS items, round(avg(score), 6) AS pooled_mean FROM i JOIN n USING (arm) GROUP BY ALL""")
def pooled_noise(spark, t):
    runs = t("events").groupBy((F.col("user_id") % 2).alias("arm"), (F.col("event_id") % 3).alias("run_id"), F.col("user_id").alias("item_id")).agg(F.avg("value").alias("score"))
    items, spread = stats.pooled(runs)
    return items.groupBy("arm").agg(F.count("*").alias("items"), F.round(F.avg("score"), 6).alias("pooled_mean")).join(spread, "arm").select("arm", "runs", "noise_range", "items", "pooled_mean")


@query()
def bootstrap_ci(spark, t):
    """Percentile intervals of resampled means: the generator is Python's, so SQL has no like; a test holds its seed."""
    return stats.bootstrap(_pairs(t).select("test", "item_id", "diff"), "test")


@query()
def bootstrap_blocks(spark, t):
    """Intervals of the mean value of each kind of event, by draws in blocks: a test holds them against a plain version."""
    return stats.bootstrap_blocks(t("events").select("event_type", "event_id", F.col("value").alias("diff")), "event_type", "event_id", 1000)


CUT = PER_QUERY.replace("rank <= 10", "rank <= 6")


@query(f"""WITH a AS (WITH {DENSE}, {PER_QUERY} SELECT query_id, n_list AS list_len, least(n_list, 8) AS ctx_len, ceiling FROM pq), b AS (WITH {DENSE}, {CUT} SELECT query_id, n_list AS list_len, least(n_list, 8) AS ctx_len, ceiling FROM pq),
m AS (SELECT avg(a.list_len) AS la, avg(b.list_len) AS lb, avg(a.ctx_len) AS ca, avg(b.ctx_len) AS cb, avg(a.ceiling) AS ea, avg(b.ceiling) AS eb FROM a JOIN b USING (query_id)), t AS (SELECT * FROM (VALUES ('retrieval', 'measures length in part'), ('ragas', 'favours the longer arm')) AS v(track, ctx))
SELECT track, 'list_len' AS "column", round(la, 4) AS base_mean, round(lb, 4) AS other_mean, abs(la - lb) > 1e-9 AS warns, 'measures length in part' AS meaning FROM m, t
UNION ALL SELECT track, 'ctx_len', round(ca, 4), round(cb, 4), abs(ca - cb) > 1e-9, ctx FROM m, t UNION ALL SELECT track, 'ceiling', round(ea, 4), round(eb, 4), abs(ea - eb) > 1e-9, 'read the ratio to the ceiling' FROM m, t
UNION ALL SELECT 'answer', 'k', 5.0, 5.0, false, 'other denominator'""")
def length_warnings(spark, t):
    """Lists of ten against lists of six, by each track's rule."""
    def arm(n):
        own = _by_label(t, dense_results(t, n))
        return own.select("query_id", F.col("n_list").alias("list_len"), F.least("n_list", F.lit(8)).alias("ctx_len"), "ceiling", F.lit(5).alias("k"))

    base, other, out = arm(10), arm(6), None
    for track in ("retrieval", "ragas", "answer"):
        own = stats.length_warnings(base, other, track, "query_id").withColumn("track", F.lit(track))
        out = own if out is None else out.unionByName(own)
    return out


@query(f"""WITH {ARMS}, s AS (SELECT *, round({SIGN}, 6) AS p FROM d), o AS (SELECT *, count(*) OVER () AS family_size, row_number() OVER (ORDER BY p, test) - 1 AS i FROM s),
h AS (SELECT *, round(max(least(1.0, (family_size - i) * p)) OVER (ORDER BY i), 6) AS p_holm FROM o)
SELECT test, n, mean_diff, p, family_size, p_holm, false AS unscored FROM h UNION ALL SELECT 'keypoint_hit', NULL, NULL, NULL, NULL, NULL, true""")
def comparison_sweep(spark, t):
    """A metric without scores is in the report, and not in the family."""
    return stats.sweep(spark, _pairs(t), (*TESTS, "keypoint_hit")).select("test", "n", "mean_diff", "p", "family_size", "p_holm", "unscored")


@query(f"WITH {ARMS} SELECT item_id, round(diff, 4) AS diff FROM p WHERE test = 'ap_at_k' ORDER BY round(diff, 4), item_id LIMIT 5")
def largest_drops(spark, t):
    return stats.largest_drops(_pairs(t).where("test = 'ap_at_k'"))


@query("""WITH i AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS n FROM benchmark), r AS (SELECT length(text) AS answer_chars, row_number() OVER (ORDER BY item_id DESC) AS n FROM benchmark)
SELECT item_id, answer_chars FROM i JOIN r USING (n)""")
def zipped_items(spark, t):
    """Items beside the rows of the same place."""
    rows = t("benchmark").select((-F.col("item_id")).alias("o"), F.length("text").alias("answer_chars"))
    return places.zipped(t("benchmark").select("item_id"), rows, ["item_id"], ["o"]).select("item_id", "answer_chars")


@query("""SELECT role, count(*) AS n, count(*) FILTER (turn % 3 <> 0) AS usage_n, (sum(length(text)) FILTER (turn % 3 <> 0))::BIGINT AS prompt_tokens, (sum(turn) FILTER (turn % 3 <> 0))::BIGINT AS completion_tokens,
  (sum(CASE WHEN conv_id % 2 = 0 THEN 7 ELSE 0 END) FILTER (turn % 3 <> 0))::BIGINT AS reasoning_tokens FROM conversations GROUP BY 1""")
def usage_totals(spark, t):
    used = F.struct(F.length("text").alias("prompt_tokens"), F.col("turn").alias("completion_tokens"), F.expr("case when conv_id % 2 = 0 then 7 end").alias("reasoning_tokens"))
    return M.usage_totals(t("conversations").withColumn("usage", F.when(F.col("turn") % 3 != 0, used)), ["role"])


@query("""SELECT count(*) FILTER (turn % 4 = 1) AS usable, count(*) FILTER (turn % 4 <> 1) AS legacy FROM conversations""")
def usable_contexts(spark, t):
    contexts = F.expr("case turn % 4 when 0 then cast(null as array<string>) when 1 then array(concat('[1] ', text)) when 2 then array(text) else cast(array() as array<string>) end")
    return t("conversations").select(T.usable_contexts(contexts).alias("u")).agg(F.count_if("u").alias("usable"), F.count_if(~F.col("u")).alias("legacy"))


KAPPA = """WITH r AS (SELECT quality = 1 AS a, n_chars >= 1000 AS b FROM documents d LEFT JOIN labels l USING (doc_id)), t AS (SELECT count(*) FILTER (a AND b) AS "both", count(*) FILTER (a AND NOT b) AS only_a,
  count(*) FILTER (NOT a AND b) AS only_b, count(*) FILTER (NOT a AND NOT b) AS neither, count(*) FILTER (a IS NULL) AS left_out FROM r), s AS (SELECT *, "both" + only_a + only_b + neither AS n FROM t),
x AS (SELECT *, ("both" + neither) / n AS po, (("both" + only_a) * ("both" + only_b) + (neither + only_a) * (neither + only_b)) / (n * n) AS pe FROM s)
SELECT "both", only_a, only_b, neither, left_out, n, round(po, 4) AS agreement, round((po - pe) / nullif(1 - pe, 0), 4) AS kappa FROM x"""


@query(KAPPA)
def kappa_agreement(spark, t):
    rows = t("documents").join(t("labels"), "doc_id", "left")
    return stats.kappa(rows, F.col("quality") == 1, F.expr("case when quality is not null then n_chars >= 1000 end"))


@query("""WITH a AS (SELECT doc_id, quality AS v FROM labels WHERE doc_id % 10 <> 3), b AS (SELECT doc_id, 1 - toxic AS v FROM labels WHERE doc_id % 10 <> 7), j AS (SELECT a.v AS a, b.v AS b FROM a FULL JOIN b USING (doc_id))
SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS "both", count(*) FILTER (b IS NULL) AS only_before, count(*) FILTER (a IS NULL) AS only_after, count(*) FILTER (a <> b) AS flips, round(avg((a = b)::INTEGER), 4) AS agreement FROM j""")
def audit_flips(spark, t):
    l = t("labels")
    before, after = l.select("doc_id", F.expr("case when doc_id % 10 <> 3 then quality end").alias("verdict")), l.select("doc_id", F.expr("case when doc_id % 10 <> 7 then 1 - toxic end").alias("verdict"))
    return stats.flips(before, after, "doc_id")


# -- robustness: conversations' assistant turns as predictions ---------------------------------------------------------------

RGB = """WITH p AS (SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 THEN '信 息不足' WHEN conv_id % 11 = 0 THEN text || '事实性错误' ELSE text END AS prediction, CASE WHEN conv_id % 2 = 0 THEN 'zh' ELSE 'en' END AS dataset,
  CASE WHEN turn % 2 = 0 THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END AS noise_rate, CASE WHEN conv_id % 13 = 0 THEN 'timeout' END AS error FROM conversations WHERE role <> 'system'),
s AS (SELECT *, CASE WHEN dataset = 'zh' THEN replace(prediction, ' ', '') ELSE prediction END AS said FROM p),
l AS (SELECT *, CASE WHEN contains(said, '信息不足') THEN [-1] ELSE [(contains(lower(said), 'the') OR contains(lower(said), 'la'))::INTEGER, contains(lower(said), 'on')::INTEGER] END AS label, contains(said, '事实性错误')::INTEGER AS factlabel FROM s)"""


def _rgb(t):
    said = F.expr("case when conv_id % 7 = 0 then '信 息不足' when conv_id % 11 = 0 then concat(text, '事实性错误') else text end")
    rows = t("conversations").where("role <> 'system'").select(
        "conv_id", "turn", said.alias("prediction"), F.expr("case when conv_id % 2 = 0 then 'zh' else 'en' end").alias("dataset"), F.expr("case when turn % 2 = 0 then 1.0D else 0.4D end").alias("noise_rate"), F.expr("case when conv_id % 13 = 0 then 'timeout' end").alias("error")
    )
    answers = F.array(F.array(F.lit("The"), F.lit("LA")), F.array(F.lit("on")))
    return rows.withColumn("label", robustness.labels(F.col("prediction"), answers, F.col("dataset") == "zh")).withColumn("factlabel", robustness.fact_label(F.col("prediction")))


@query(f"{RGB} SELECT conv_id, turn, array_to_string(label, ',') AS label, factlabel FROM l")
def rgb_labels(spark, t):
    return _rgb(t).select("conv_id", "turn", F.array_join(F.transform("label", lambda x: x.cast("string")), ",").alias("label"), "factlabel")


@query(f"""{RGB}, c AS (SELECT *, (noise_rate = 1 AND label[1] = -1) OR (NOT list_contains(label, 0) AND list_contains(label, 1)) AS ok, label[1] = -1 AS rej, factlabel = 1 AS f FROM l)
SELECT dataset, noise_rate, count(*) FILTER (error IS NULL) AS n, count(*) FILTER (error IS NOT NULL) AS n_errors, round(avg(CASE WHEN error IS NULL THEN ok::INTEGER END), 4) AS accuracy, round(avg(CASE WHEN error IS NULL THEN rej::INTEGER END), 4) AS rejection_strict,
  round(avg(CASE WHEN error IS NULL THEN f::INTEGER END), 4) AS error_detection, round(coalesce(avg(CASE WHEN error IS NULL AND f THEN (NOT list_contains(label, 0))::INTEGER END), 0), 4) AS error_correction FROM c GROUP BY ALL""")
def rgb_rates(spark, t):
    return robustness.summary(_rgb(t), ["dataset", "noise_rate"])


@query("""WITH z AS (SELECT count(*) AS n FROM benchmark), c AS (SELECT * FROM (VALUES ('zh', 6), ('zh_refine', 6), ('zh_int', 3), ('zh_fact', 1)) AS v(dataset, rates)) SELECT dataset, rates::BIGINT AS rates, (rates * least(n, 30))::BIGINT AS calls, (rates * n)::BIGINT AS full_calls, round(n / least(n, 30), 4) AS scale FROM c, z""")
def rgb_call_plan(spark, t):
    n = t("benchmark").agg(F.count("*").alias("n"))
    plan = robustness.combos(spark)
    return robustness.call_plan(plan, plan.select("dataset").distinct().crossJoin(n), 30)  # n is one row


ROLES = """g AS (SELECT conv_id AS id, count(*) FILTER (role = 'assistant') AS np, count(*) FILTER (role = 'user') AS nn, count(*) FILTER (role = 'system') AS ns FROM conversations GROUP BY 1)"""


def _records(t):
    """Each conversation as a record: assistant turns (a...) and user turns (u...) in order."""
    pick = lambda role: F.array_compact(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", F.concat(F.lit(role[0]), "text").alias("x"))))), lambda s: s["x"]))
    return t("conversations").groupBy(F.col("conv_id").alias("id")).agg(pick("assistant").alias("a"), pick("user").alias("u"), pick("system").alias("s"))


def _kinds(out, **kinds):
    def of(c):
        return F.size(F.filter("docs", lambda d: d.startswith(c))).cast("long")

    return out.select("id", "dataset", "noise_rate", *(of(c).alias(name) for name, c in kinds.items()))


@query(f"""WITH {ROLES}, c AS (SELECT *, CASE WHEN noise_rate = 1 THEN 'zh_refine' ELSE 'zh' END AS dataset FROM g, (VALUES (0.4::DOUBLE), (1.0::DOUBLE)) AS r(noise_rate)),
k AS (SELECT *, CASE WHEN noise_rate = 1 THEN 0 WHEN 2 > nn THEN 5 - nn WHEN 3 > np THEN np ELSE 3 END AS tp, CASE WHEN noise_rate = 1 THEN 5 WHEN 2 > nn THEN nn WHEN 3 > np THEN 5 - np ELSE 2 END AS tn FROM c)
SELECT id, dataset, noise_rate, least(tp, np)::BIGINT AS positives, least(tn, nn)::BIGINT AS negatives FROM k""")
def rgb_assembly(spark, t):
    """How many documents of either kind each record of a plain set gets; their order comes from a seeded generator."""
    rows = _records(t).select("id", F.col("a").alias("positive"), F.col("u").alias("negative"), F.explode(F.array(F.lit(0.4), F.lit(1.0))).alias("noise_rate"))
    return _kinds(robustness.assemble(rows.withColumn("dataset", F.expr("case when noise_rate = 1 then 'zh_refine' else 'zh' end"))), positives="a", negatives="u")


@query(f"""WITH {ROLES}, k AS (SELECT *, (np > 0)::INTEGER + (ns > 0)::INTEGER AS heads FROM g, (VALUES (0.0::DOUBLE), (0.4::DOUBLE)) AS r(noise_rate)),
m AS (SELECT *, heads + least(greatest(5 - ceil(5 * noise_rate)::INTEGER - heads, 0), np + ns - heads) AS n FROM k) SELECT id, 'zh_int' AS dataset, noise_rate, n::BIGINT AS positives, least(nn, greatest(5 - n, 0))::BIGINT AS negatives FROM m""")
def rgb_assembly_integration(spark, t):
    """Groups of assistant and of system turns: a document of each, deeper ones up to the share, user turns as noise."""
    rows = _records(t).select("id", F.transform(F.array("a", "s"), lambda g: F.transform(g, lambda x: F.concat(F.lit("p"), x))).alias("groups"), F.col("u").alias("negative"), F.explode(F.array(F.lit(0.0), F.lit(0.4))).alias("noise_rate"))
    return _kinds(robustness.assemble(rows.withColumn("dataset", F.lit("zh_int"))), positives="p", negatives="u")


@query(f"""WITH {ROLES}, k AS (SELECT *, least(np, 5 - ceil(5 * correct_rate)::INTEGER) AS altered, ceil(5 * correct_rate)::INTEGER AS r FROM g, (VALUES (0.0::DOUBLE), (0.4::DOUBLE)) AS c(correct_rate))
SELECT id, 'zh_fact' AS dataset, correct_rate AS noise_rate, altered::BIGINT AS altered, least(np - altered, r)::BIGINT AS true_ones FROM k""")
def rgb_assembly_counterfactual(spark, t):
    """Altered documents without noise, and with two of five right ones (the rate is shown as noise_rate)."""
    rows = _records(t).select("id", F.col("a").alias("positive"), F.transform("a", lambda x: F.concat(F.lit("w"), x)).alias("wrong"), F.col("u").alias("negative"), F.explode(F.array(F.lit(0.0), F.lit(0.4))).alias("correct_rate"))
    out = robustness.assemble(rows.where("correct_rate = 0").withColumn("dataset", F.lit("zh_fact")).withColumn("noise_rate", F.lit(0.0)))
    some = robustness.assemble(rows.where("correct_rate > 0").withColumn("dataset", F.lit("zh_fact")).withColumn("noise_rate", F.lit(0.0))).withColumn("noise_rate", F.lit(0.4))
    return _kinds(out.union(some), altered="w", true_ones="a")


#: Three runs over the documents, whose readings are functions of their ids; the last one broke off.
RUN_ITEMS = """d AS (SELECT doc_id, n_chars, r FROM documents, range(0, 3) AS x(r) WHERE r < 2 OR doc_id % 4 <> 0),
u AS (SELECT 'run' || r AS run_id, doc_id::VARCHAR AS id, CASE WHEN doc_id % 9 <> 0 THEN (doc_id + r) % 5 / 4.0::DOUBLE END AS coverage, CASE WHEN doc_id % 3 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS ceiling, CASE WHEN (doc_id + r) % 5 > 0 THEN (n_chars + r) % 12 END AS hit, doc_id % 2 = 0 AS ok FROM d)"""


def _run_items(spark, t):
    d = t("documents").select("doc_id", "n_chars").crossJoin(F.broadcast(spark.range(3).select(F.col("id").cast("int").alias("r")))).where("r < 2 or doc_id % 4 <> 0")  # three rows a document
    return d.selectExpr(
        "concat('run', r) as run_id", "cast(doc_id as string) as id", "case when doc_id % 9 <> 0 then (doc_id + r) % 5 / 4.0D end as doc_coverage", "case when doc_id % 3 = 0 then 0.0D else 1.0D end as doc_coverage_ceiling",
        "cast(case when (doc_id + r) % 5 > 0 then (n_chars + r) % 12 end as int) as first_hit_rank", "case when doc_id % 7 > 0 then doc_id % 2 = 0 end as answered_ok",
    )


@query(f"""WITH {RUN_ITEMS}, m AS (SELECT run_id, id AS item_id, 'hit_at_5' AS metric, 'retrieval' AS track, (coalesce(hit, 0) BETWEEN 1 AND 5)::INTEGER::DOUBLE AS score FROM u WHERE coverage IS NOT NULL
UNION ALL SELECT run_id, id, 'hit_at_list', 'retrieval', (coalesce(hit, 0) > 0)::INTEGER::DOUBLE FROM u WHERE coverage IS NOT NULL UNION ALL SELECT run_id, id, 'mrr', 'retrieval', coalesce(1.0::DOUBLE / nullif(hit, 0), 0) FROM u WHERE coverage IS NOT NULL
UNION ALL SELECT run_id, id, 'recall_vs_ceiling', 'retrieval', coverage / ceiling FROM u WHERE coverage IS NOT NULL AND ceiling > 0 UNION ALL SELECT run_id, id, 'answered_ok', 'answer', ok::INTEGER::DOUBLE FROM u WHERE id::BIGINT % 7 > 0)
SELECT * FROM m WHERE run_id <> 'run2'""")
def run_item_scores(spark, t):
    """Scores by item of the runs that may be read: an older name of a metric among them, and a run that is refused."""
    items = _run_items(spark, t)
    runs = t("documents").agg(F.count("*").alias("expected")).select(F.explode(F.array(*(F.lit(f"run{i}") for i in range(3)))).alias("run_id"), F.lit(False).alias("partial"), "expected")
    whole = items.join(F.broadcast(stats.refused_runs(runs, items).select("run_id")), "run_id", "left_anti")  # at most a row for each run
    return stats.item_scores(whole, ["hit_at_5", "hit_within_budget", "mrr", "coverage_vs_ceiling", "answered_ok"]).select("run_id", "item_id", "metric", "track", "score")

"""Rank metrics, answer metrics, latency and audits. NULL means undefined, is left out of means, and is never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowdoc.functions.text import citations, citations_valid, is_refusal
from sparrowdoc.sources.shared import Workspace

DIGITS = 4


def share(hit: Column) -> Column:
    """Mean of a condition, NULLs left out."""
    return F.avg(hit.cast("int"))


def distinct_ranking(results: DataFrame, doc: str = "doc_id") -> DataFrame:
    """A document's first place in a query's list, places counted by document."""
    first = results.groupBy("query_id", doc).agg(F.min("rank").alias("first_rank"))
    return first.withColumn("doc_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first_rank", doc)))


def rank_metrics(results: DataFrame, gold: DataFrame, k: int = 5, wide: int = 8, doc: str = "doc_id") -> DataFrame:
    """For each query of gold (query_id, doc): the standard readings of its list.

    n_gold, n_list (chunks, copies included), first_hit (in chunks), recall, precision, ap and ndcg at k, ndcg at `wide`,
    coverage of the whole list, its ceiling and their ratio. Queries without results have misses; queries without gold
    are not in gold and have no row. Rounded to 4 places, halves up.
    """
    wanted = gold.select("query_id", F.col(doc)).distinct()
    n_gold = wanted.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    return _readings(results, n_gold, distinct_ranking(results, doc).join(wanted, ["query_id", doc]), k, wide)


def class_rank_metrics(results: DataFrame, asked: DataFrame, rows: DataFrame, k: int = 5, wide: int = 8, doc: str = "doc_id") -> DataFrame:
    """rank_metrics() where a query's gold is every row of its class but the one of its own id: asked (query_id, class), rows (doc,
    class), one class for each id.

    No pairs of query and gold are made, whose number would grow with the square of the rows: classes are counted, and
    the results alone are held against them. A NULL class has no rows.
    """
    of = rows.where("class is not null").select(F.col(doc), "class").distinct()
    who = asked.select("query_id", "class").distinct()
    own = of.select(F.col(doc).alias("query_id"), "class", F.lit(1).alias("own"))
    sizes = who.join(of.groupBy("class").agg(F.count("*").alias("n")), "class").join(own, ["query_id", "class"], "left")
    n_gold = sizes.select("query_id", (F.col("n") - F.coalesce("own", F.lit(0))).alias("n_gold")).where("n_gold > 0")
    hits = distinct_ranking(results, doc).where(F.col("query_id") != F.col(doc)).join(of, doc).join(who, ["query_id", "class"]).drop("class")
    return _readings(results, n_gold, hits, k, wide)


def _readings(results: DataFrame, n_gold: DataFrame, hits: DataFrame, k: int, wide: int) -> DataFrame:
    """The metrics from n_gold (query_id, n_gold) and the gold among the results' documents."""
    lists = results.groupBy("query_id").agg(F.count("*").alias("n_list"))
    so_far = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_rank"))
    hits = hits.withColumn("so_far", so_far)
    gain = 1 / F.log2(F.col("doc_rank") + 1)
    read = hits.groupBy("query_id").agg(
        F.min("first_rank").alias("first_hit"),
        F.count("*").alias("n_hits"),
        F.count_if(F.col("doc_rank") <= k).alias("hits_k"),
        F.sum(F.when(F.col("doc_rank") <= k, F.col("so_far") / F.col("doc_rank"))).alias("ap_sum"),
        F.sum(F.when(F.col("doc_rank") <= k, gain)).alias("dcg_k"),
        F.sum(F.when(F.col("doc_rank") <= wide, gain)).alias("dcg_wide"),
    )

    def ideal(n: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.least("n_gold", F.lit(n)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))

    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    r = lambda c: F.round(c, DIGITS)
    out = n_gold.join(lists, "query_id", "left").join(read, "query_id", "left").withColumn("n_list", zero("n_list"))
    ceiling = F.least("n_gold", "n_list") / F.col("n_gold")
    return out.select(
        "query_id", "n_gold", "n_list", "first_hit",
        r(zero("hits_k") / F.col("n_gold")).alias("recall_at_k"),
        r(zero("hits_k") / F.lit(k)).alias("precision_at_k"),
        r(zero("ap_sum") / F.least("n_gold", F.lit(k))).alias("ap_at_k"),
        r(zero("dcg_k") / ideal(k)).alias("ndcg_at_k"),
        r(zero("dcg_wide") / ideal(wide)).alias("ndcg_at_wide"),
        r(zero("n_hits") / F.col("n_gold")).alias("recall_at_list"),
        r(ceiling).alias("ceiling"),
        r(zero("n_hits") / F.col("n_gold") / F.nullif(ceiling, F.lit(0.0))).alias("recall_vs_ceiling"),
    )


def retrieval_summary(per_query: DataFrame, by: list[str] | None = None, k: int = 5, wide: int = 8) -> DataFrame:
    """Hit rates, MRR and means over queries, with their number."""
    hit = F.col("first_hit")
    rows = per_query.groupBy(*(by or []))
    r = lambda c: F.round(c, DIGITS)
    return rows.agg(
        F.count("*").alias("n"),
        r(share(F.coalesce(hit <= k, F.lit(False)))).alias("hit_at_k"),
        r(share(F.coalesce(hit <= wide, F.lit(False)))).alias("hit_at_wide"),
        r(share(hit.isNotNull())).alias("hit_at_list"),
        r(F.avg(F.coalesce(1 / hit, F.lit(0.0)))).alias("mrr"),
        *(r(F.avg(c)).alias(f"mean_{c}") for c in ("recall_at_k", "precision_at_k", "ap_at_k", "ndcg_at_k", "recall_at_list", "ceiling", "recall_vs_ceiling")),
        F.min("n_list").alias("shortest_list"),
        F.max("n_list").alias("longest_list"),
    )


def macro_mean(per_item: DataFrame, by: str, value: str) -> DataFrame:
    """Mean of the types' means; a type without values has none and does not count."""
    types = per_item.where(F.col(value).isNotNull()).groupBy(by).agg(F.avg(value).alias("m"))
    return types.agg(F.count("*").alias("n_types"), F.round(F.avg("m"), DIGITS).alias("macro_mean"))


def answer_checks(answers: DataFrame, answer: str = "answer", contexts: str = "n_contexts", refusable: str = "refusable", markers=None) -> DataFrame:
    """answers with refused, refusal_ok, over_refused, citation_present and citation_valid; NULL where they do not apply."""
    c = F.col(answer)
    answered = F.length(F.trim(c)) > 0
    refused = F.when(answered, is_refusal(c, markers) if markers else is_refusal(c))
    out = answers.withColumn("refused", refused)
    out = out.withColumn("refusal_ok", F.when(F.col(refusable), F.col("refused"))).withColumn("over_refused", F.when(~F.col(refusable), F.col("refused")))
    out = out.withColumn("citation_present", F.when(answered, F.size(citations(c)) > 0))
    return out.withColumn("citation_valid", F.when(answered, citations_valid(c, F.col(contexts))))


def keypoint_grades(hits: DataFrame, by: list[str], hit: str = "hit") -> DataFrame:
    """Key points found of those asked, the share, and the grade: full from four fifths (rounded up), half, zero."""
    out = hits.groupBy(*by).agg(F.count("*").alias("k"), F.count_if(hit).alias("hits"))
    # four fifths in whole numbers: 0.8 has no exact binary form
    grade = F.when(F.col("hits") >= F.ceil(F.col("k") * 4 / 5), "full").when(F.col("hits") > 0, "half").otherwise("zero")
    return out.withColumn("keypoint_recall", F.round(F.col("hits") / F.col("k"), DIGITS)).withColumn("grade", grade)


def routing(rows: DataFrame, expected: Column, predicted: Column, usable: Column | None = None) -> DataFrame:
    """Recall and false trigger rate of a routing decision, NULL on empty denominators; unusable rows are counted apart."""
    ok = usable if usable is not None else F.lit(True)
    n, m = F.count_if(ok & expected), F.count_if(ok & ~expected)
    return rows.agg(
        n.alias("expected"), m.alias("not_expected"), F.count_if(~ok).alias("left_out"),
        F.round(F.count_if(ok & expected & predicted) / F.nullif(n, F.lit(0)), DIGITS).alias("recall"),
        F.round(F.count_if(ok & ~expected & predicted) / F.nullif(m, F.lit(0)), DIGITS).alias("false_trigger"),
    )


def gate(rates: DataFrame, recall: float = 0.8, false_trigger: float = 0.1) -> DataFrame:
    return rates.withColumn("passes", F.coalesce((F.col("recall") >= recall) & (F.col("false_trigger") <= false_trigger), F.lit(False)))


def nearest_rank(value: str, percent: float, digits: int = 1) -> Column:
    """Nearest-rank quantile of groups of bounded size: the value at place ceil(n * p) of those in order. The aggregate holds a
    group's distinct values; exact_quantiles() does not."""
    return F.round(F.expr(f"percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY {value})"), digits)


#: Rows of a bracket that are sorted, buckets that a larger one is cut into, and passes after which any is sorted.
SORTED, BUCKETS, PASSES = 100_000, 256, 64


def exact_quantiles(rows: DataFrame, by: list[str], value: str, percents: dict[str, float], sorted_rows: int = SORTED) -> DataFrame:
    """by, n, and nearest-rank quantiles (name -> percent) of the numbers in `value`, exact, in fixed memory a group.

    A quantile's place lies in a bracket of values, at first all of the group's. A pass counts a bracket's values in BUCKETS equal parts
    and goes on with the part that has the place, from its smallest to its largest value, until few rows or one value are left; few
    rows are sorted. No buffer holds a group's values, and a pass' counts are combined where the rows are. Nulls and NaN take no
    part; a group without any other value has n = 0 and no quantiles. Null groups are groups. Starts a job a pass when called.
    """
    work = Workspace(rows.sparkSession)
    key = F.struct(*by)
    number = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    own = rows.select(key.alias("k"), number.alias("v"))
    groups = own.groupBy("k").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    if groups.where(F.col("n") > sorted_rows).isEmpty():  # each group is few rows
        whole = Window.partitionBy("k")
        ranks = own.withColumn("n", F.count("v").over(whole)).withColumn("i", F.row_number().over(whole.orderBy(F.asc_nulls_last("v"))))
        at = lambda p: F.greatest(F.lit(1), F.ceil(F.col("n") * float(p) / 100))
        found = ranks.groupBy("k").agg(F.max("n").alias("n"), *(F.max(F.when(F.col("i") == at(p), F.col("v"))).alias(name) for name, p in percents.items()))
        return found.select("k.*", "n", *percents)
    groups = work.keep(groups)
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("q"), F.lit(float(p)).alias("p")) for name, p in percents.items())))
    place = F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("x.p") / 100)).cast("long")
    fields = ["k", "q", "place", "size", "lo", "hi"]
    brackets = groups.where("n > 0").select("k", "n", "lo", "hi", asked.alias("x")).select("k", F.col("x.q").alias("q"), place.alias("place"), F.col("n").alias("size"), "lo", "hi")
    wide = (F.col("size") > sorted_rows) & (F.col("lo") < F.col("hi"))
    own = own.where("v is not null")
    for _ in range(PASSES):
        large = brackets.where(wide)
        if large.isEmpty():
            break
        half = lambda c: F.col(c).cast("double") / 2  # noqa: E731  a difference of halves does not overflow
        part = F.least(F.lit(BUCKETS - 1), F.floor((half("v") - half("lo")) / (half("hi") - half("lo")) * BUCKETS))
        inside = own.join(large, "k").where("v between lo and hi").withColumn("part", part)
        counts = inside.groupBy("k", "q", "place", "part").agg(F.count("*").alias("size"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("size").over(Window.partitionBy("k", "q").orderBy("part"))  # BUCKETS rows
        held = counts.withColumn("upto", upto).where("upto >= place and upto - size < place").withColumn("place", F.col("place") - F.col("upto") + F.col("size"))
        brackets = work.keep(brackets.where(~wide).select(*fields).union(held.select(*fields)))
    one = brackets.where("lo = hi").select("k", "q", F.col("lo").alias("v"))
    order = F.row_number().over(Window.partitionBy("k", "q").orderBy("v"))
    few = own.join(brackets.where("lo < hi"), "k").where("v between lo and hi").withColumn("i", order).where("i = place").select("k", "q", "v")
    found = one.union(few).groupBy("k").agg(*(F.max(F.when(F.col("q") == name, F.col("v"))).alias(name) for name in percents))
    return groups.select("k", "n").join(found, "k", "left").select("k.*", "n", *percents)


def beside(rows: DataFrame, more: DataFrame, by: list[str]) -> DataFrame:
    """rows with the columns of their group's row in `more`; null groups meet."""
    key = lambda f: F.struct(*(f[c] for c in by))
    return rows.join(more.select(key(more).alias("__k"), *(c for c in more.columns if c not in by)), F.struct(*(rows[c] for c in by)) == F.col("__k"), "left").drop("__k")


def picked_quantile(rows: DataFrame, by: list[str], value: str, place: Column, name: str = "q") -> DataFrame:
    """The value at a place (from 0) of a group's values in order; place may use the column n."""
    window = Window.partitionBy(*by)
    own = rows.where(F.col(value).isNotNull()).withColumn("n", F.count("*").over(window)).withColumn("i", F.row_number().over(window.orderBy(value)) - 1)
    return own.where(F.col("i") == place.cast("int")).groupBy(*by).agg(F.min(value).alias(name))


def latency_summary(log: DataFrame, by: str, value: str, cached: Column, limit: Column) -> DataFrame:
    """Quantiles of a group's latencies, of the uncached ones alone, and whether its 95th percentile meets the limit:
    undefined with any cached answer or with none at all."""
    out = log.withColumn("__c", cached).withColumn("__l", limit).withColumn("__u", F.when(~F.col("__c"), F.col(value)))
    g = out.groupBy(by).agg(F.count(value).alias("n"), F.count_if("__c").alias("n_cached"), F.max("__l").alias("limit_ms"))
    g = beside(g, exact_quantiles(out, [by], value, {"p50": 50, "p95": 95}).drop("n"), [by])
    g = beside(g, exact_quantiles(out, [by], "__u", {"uncached_p95": 95}).drop("n"), [by])
    g = g.withColumns({c: F.round(c, 1) for c in ("p50", "p95", "uncached_p95")}).select(by, "n", "n_cached", "p50", "p95", "uncached_p95", "limit_ms")
    return g.withColumn("meets", F.when((F.col("n") > 0) & (F.col("n_cached") == 0), F.col("p95") <= F.col("limit_ms")))


def last_samples(log: DataFrame, key: str, order: list[str], most: int = 500) -> DataFrame:
    """The last rows of each key."""
    window = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return log.withColumn("__n", F.row_number().over(window)).where(F.col("__n") <= most).drop("__n")


def missing_audit(rows: DataFrame, by: str, value: str, most: float = 0.2, least: int = 5) -> DataFrame:
    """Missing values by type, and whether a run must be rejected: too many overall, or in a type of some size."""
    types = rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col(value).isNull()).alias("missing"))
    every = rows.agg(F.count("*").alias("n"), F.count_if(F.col(value).isNull()).alias("missing")).select(F.lit("all").alias(by), "n", "missing")
    out = types.withColumn(by, F.col(by).cast("string")).unionByName(every).withColumn("rate", F.round(F.col("missing") / F.nullif(F.col("n"), F.lit(0)), DIGITS))
    bad = (F.col("missing") > most * F.col("n")) & ((F.col(by) == "all") | (F.col("n") >= least))
    return out.withColumn("rejected", bad)


def hit_rate(log: DataFrame, hit: Column, miss: Column) -> DataFrame:
    h, m = F.count_if(hit), F.count_if(miss)
    return log.agg(h.alias("hits"), m.alias("misses"), F.round(h / F.nullif(h + m, F.lit(0)), DIGITS).alias("hit_rate"))


def repeat_spans(runs: DataFrame, run: str, metric: str, value: str) -> DataFrame:
    """Largest minus smallest of each metric that every run has."""
    n = runs.select(F.countDistinct(run).alias("runs"))
    out = runs.where(F.col(value).isNotNull()).groupBy(metric).agg(F.countDistinct(run).alias("have"), (F.max(value) - F.min(value)).alias("span"))
    return out.crossJoin(F.broadcast(n)).where("have = runs").select(metric, F.round("span", DIGITS).alias("span"))


def usage_totals(rows: DataFrame, by: list[str], usage: str = "usage", kinds: tuple[str, ...] = ("prompt_tokens", "completion_tokens", "reasoning_tokens")) -> DataFrame:
    """Sums of recorded usage (a struct) and the number of rows that have any; a row without is not a row of 0. A kind that a
    record lacks adds nothing."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count(usage).alias("usage_n"), *(F.sum(F.when(F.col(usage).isNotNull(), F.coalesce(F.col(f"{usage}.{k}"), F.lit(0)))).cast("long").alias(k) for k in kinds))


#: Targets of the two kinds of question, in milliseconds, and the types of the first kind.
TARGETS, AGGREGATE_TYPES = {"aggregate": 5000, "short": 8000}, ("cross_doc", "time_filter")


def latency_targets(log: DataFrame, kind: str, total: str, cached: Column, with_answers: bool = True) -> DataFrame:
    """bucket, target_ms, n_uncached, p95, meets for aggregate and short questions: quantiles of uncached answers alone;
    NULL, not met, where any answer of the whole run was cached, or none was asked for."""
    own = log.withColumn("__c", cached).withColumn("bucket", F.when(F.col(kind).isin(*AGGREGATE_TYPES), "aggregate").otherwise("short"))
    tainted = own.agg(F.coalesce(F.max("__c"), F.lit(False)).alias("tainted"))  # one row
    rows = exact_quantiles(own.withColumn("__u", F.when(~F.col("__c"), F.col(total))), ["bucket"], "__u", {"p95": 95})
    rows = rows.select("bucket", F.col("n").alias("n_uncached"), F.round("p95", 1).alias("p95"))
    target = F.when(F.col("bucket") == "aggregate", F.lit(TARGETS["aggregate"])).otherwise(F.lit(TARGETS["short"]))
    ok = F.when(~F.col("tainted") & F.lit(with_answers) & F.col("p95").isNotNull(), F.col("p95") <= target)
    return rows.crossJoin(F.broadcast(tainted)).select("bucket", target.alias("target_ms"), "n_uncached", "p95", ok.alias("meets"))


def date_coverage(docs: DataFrame, by: str, date: str, least: int = 2000) -> DataFrame:
    """Documents of each group, those dated in a year of `least` or later, and their share."""
    dated = F.count_if(F.coalesce(F.year(date) >= least, F.lit(False)))
    return docs.groupBy(by).agg(F.count("*").alias("n"), dated.alias("dated"), F.round(dated / F.count("*"), DIGITS).alias("coverage"))

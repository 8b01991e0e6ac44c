"""Paired comparison of runs: pooling, differences, bootstrap, sign test, Holm correction, sensitivity, agreement."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowdoc.operators.places import placed
from sparrowdoc.sources.shared import Workspace

DIGITS, TIE = 4, 1e-9
#: Older names of metrics, what they are called now, and all names.
METRIC_ALIASES = {"hit_within_budget": "hit_at_list", "mean_doc_coverage": "recall_at_list", "coverage_vs_ceiling": "recall_vs_ceiling", "keypoint_hit_ratio": "keypoint_recall"}
ANSWER_METRICS = ("answered_ok", "keypoint_recall")
JUDGED = ("faithfulness", "answer_relevancy")
METRICS = ("hit_at_5", "hit_at_8", "hit_at_list", "mrr", "ndcg_at_5", "ndcg_at_8", "recall_at_5", "recall_at_list", "recall_vs_ceiling", "precision_at_5", "map_at_5", "answered_ok", "keypoint_recall")


def metric_name(name: str) -> str:
    name = METRIC_ALIASES.get(name, name)
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; there are {METRICS}")
    return name


def complete(run_items: DataFrame, expected: int) -> DataFrame:
    """run_items of a whole run; a part of one is no evidence."""
    n = run_items.count()
    if n < expected:
        raise ValueError(f"a partial run: {n} of {expected} items")
    return run_items


#: The fields of an item in a run's results, and of a judge's scores.
RUN_ITEM = """id string, type string, doc_coverage double, doc_coverage_ceiling double, first_hit_rank int, ndcg_at_5 double, ndcg_at_8 double, recall_at_5 double,
precision_at_5 double, ap_at_5 double, answered_ok boolean, keypoint_hit double, n_retrieved int, n_contexts int, n_key_points int"""
JUDGED_ITEM = "id string, type string, n_contexts int, faithfulness double, answer_relevancy double"


def _score(metric: str) -> Column:
    """An item's value of a metric, or NULL where it has none: without gold there is no retrieval to score."""
    if metric in JUDGED:
        return F.col(metric)
    if metric == "keypoint_recall":
        return F.col("keypoint_hit")
    if metric == "answered_ok":
        return F.col("answered_ok").cast("double")
    rank, gold = F.nullif("first_hit_rank", F.lit(0)), F.col("doc_coverage").isNotNull()
    if metric == "mrr":
        value = F.coalesce(1 / rank, F.lit(0.0))
    elif metric == "recall_at_list":
        value = F.col("doc_coverage")
    elif metric == "recall_vs_ceiling":
        value = F.col("doc_coverage") / F.nullif("doc_coverage_ceiling", F.lit(0.0))
    elif metric.startswith("hit_at_"):
        near = F.lit(True) if metric == "hit_at_list" else rank <= int(metric.removeprefix("hit_at_"))
        value = F.coalesce(rank.isNotNull() & near, F.lit(False)).cast("double")
    else:
        value = F.col("ap_at_5" if metric == "map_at_5" else metric)
    return F.when(gold, value.cast("double"))


def item_scores(items: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """run_id, item_id, type, metric, track, score, list_len, ctx_len, ceiling, k: a row for each item and metric that has a value.

    items has run_id and RUN_ITEM (or JUDGED_ITEM for a judge's metrics; fields that it lacks are NULL). Older names of metrics
    are understood; without a list all that items can hold are given. No shuffle: each item becomes its metrics' rows.
    """
    judged = all(m in items.columns for m in JUDGED)
    chosen = list(dict.fromkeys(m if m in JUDGED else metric_name(m) for m in metrics)) if metrics else [*(METRICS if "doc_coverage" in items.columns else ()), *(JUDGED if judged else ())]
    fields = [f.split() for f in f"{RUN_ITEM}, {JUDGED_ITEM}".replace("\n", " ").split(",")]
    known = {name for name, _ in fields}
    full = items.select("run_id", *(c for c in items.columns if c in known))
    for name, kind in fields:
        if name not in full.columns:
            full = full.withColumn(name, F.lit(None).cast(kind))
    track = lambda m: "judged" if m in JUDGED else "answer" if m in ANSWER_METRICS else "retrieval"
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(track(m)).alias("track"), _score(m).alias("score")) for m in chosen))
    return full.select("run_id", F.col("id").alias("item_id"), F.coalesce("type", F.lit("")).alias("type"), F.inline(F.filter(each, lambda e: e["score"].isNotNull())), F.col("n_retrieved").alias("list_len"), F.col("n_contexts").alias("ctx_len"), F.col("doc_coverage_ceiling").alias("ceiling"), F.col("n_key_points").alias("k"))


def refused_runs(runs: DataFrame, items: DataFrame) -> DataFrame:
    """run_id, reason, n of the runs (run_id, partial, expected: NULL if unknown) that are no evidence: marked as partial, without
    items, with an item twice, or with fewer than expected. n counts distinct items."""
    counts = items.groupBy("run_id").agg(F.count("*").alias("rows"), F.countDistinct("id").alias("n"))
    both = runs.select("run_id", "partial", "expected").join(counts, "run_id", "left").na.fill(0, ["rows", "n"])
    reason = F.when(F.coalesce("partial", F.lit(False)), "partial").when(F.col("n") == 0, "no items").when(F.col("rows") > F.col("n"), "an item twice").when(F.col("n") < F.col("expected"), "too few items")
    return both.withColumn("reason", reason).where("reason is not null").select("run_id", "reason", "n")


def read_runs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Result files as (runs, items, judged): run_id (the file's name), malformed, partial, expected; run_id and RUN_ITEM; run_id and JUDGED_ITEM.

    A file is a JSON object: meta (partial, n_items), items, and a judge's per_item under summary or, beside it, under ragas, the
    first that is there. A file that is none is malformed and partial, so that refused_runs() names it.
    """
    per = f"struct<per_item: array<{_struct(JUDGED_ITEM)}>>"
    schema = f"meta struct<partial: boolean, n_items: long>, items array<{_struct(RUN_ITEM)}>, summary {per}, ragas {per}"
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("run_id"), F.from_json("value", schema).alias("r"), F.coalesce(F.try_parse_json("value").isNull(), F.lit(True)).alias("malformed"))
    runs = rows.select("run_id", "malformed", (F.col("malformed") | F.coalesce("r.meta.partial", F.lit(False))).alias("partial"), F.col("r.meta.n_items").alias("expected"))
    judged = F.coalesce("r.summary.per_item", "r.ragas.per_item")
    return runs, rows.select("run_id", F.inline("r.items")), rows.select("run_id", F.inline(judged))


def _struct(fields: str) -> str:
    return "struct<" + ", ".join(": ".join(f.split()) for f in fields.replace("\n", " ").split(",")) + ">"


def load_scores(spark: SparkSession, path: str, metric: str) -> DataFrame:
    """item_scores() of a metric from result files; an error that names the runs, if any may not be read as evidence. A job looks at
    the runs before the result is returned."""
    runs, items, judged = read_runs(spark, path)
    own = judged if metric in JUDGED else items
    bad = refused_runs(runs, own).orderBy("run_id").limit(20).collect()
    if bad:
        raise ValueError("not to be read as whole runs: " + "; ".join(f"{r.run_id}: {r.reason}" for r in bad))
    return item_scores(own, [metric])


def pooled(runs: DataFrame, group: str = "arm", run: str = "run_id", item: str = "item_id", score: str = "score") -> tuple[DataFrame, DataFrame]:
    """Each item's mean over an arm's repeated runs; and for each arm the runs and the range of their means (NULL for one)."""
    scored = runs.where(F.col(score).isNotNull())
    items = scored.groupBy(group, item).agg(F.avg(score).alias("score"))
    means = scored.groupBy(group, run).agg(F.avg(score).alias("m")).groupBy(group)
    spread = means.agg(F.count("*").alias("runs"), F.when(F.count("*") > 1, F.round(F.max("m") - F.min("m"), 6)).alias("noise_range"))
    return items, spread


def paired(base: DataFrame, other: DataFrame, item: str = "item_id", score: str = "score") -> DataFrame:
    """Items scored in both arms, with the difference other - base."""
    a = base.where(F.col(score).isNotNull()).select(item, F.col(score).alias("base"))
    b = other.where(F.col(score).isNotNull()).select(item, F.col(score).alias("other"))
    return a.join(b, item).withColumn("diff", F.col("other") - F.col("base"))


def difference(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means, wins, losses and ties of a pairing."""
    return pairs.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.round(F.avg("base"), DIGITS).alias("mean_base"), F.round(F.avg("other"), DIGITS).alias("mean_other"), F.round(F.avg("diff"), DIGITS).alias("mean_diff"),
        F.count_if(F.col("diff") > TIE).alias("wins"), F.count_if(F.col("diff") < -TIE).alias("losses"), F.count_if(F.abs("diff") <= TIE).alias("ties"),
    )


def sign_p(wins: Column, losses: Column) -> Column:
    """Two-sided exact sign test: twice the smaller tail of the binomial at one half, at most 1.

    Terms follow from one another, C(n,i+1) = C(n,i)(n-i)/(i+1). Term and sum have a power of two of their own, which starts
    at 2**-n and takes over whenever the term grows past 2**500, so that doubles hold them for any n.
    """
    n, k = (wins + losses).cast("int"), F.least(wins, losses).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"), (-n).alias("power"))

    def step(acc: Column, i: Column) -> Column:
        by = F.when(acc["term"] > 2.0**500, F.lit(2.0**-500)).otherwise(F.lit(1.0))
        term = acc["term"] * by * (n - i + 1) / i
        power = acc["power"] + F.when(acc["term"] > 2.0**500, F.lit(500)).otherwise(F.lit(0))
        return F.struct(term.alias("term"), (acc["sum"] * by + term).alias("sum"), power.alias("power"))

    last = F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.expr("cast(array() as array<int>)")), start, step)
    tail = last["sum"] * F.lit(2.0**-500) * F.pow(F.lit(2.0), last["power"] + 500)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def exact_sign_p(wins: int, losses: int) -> float:
    """The same in whole numbers, for any n."""
    n = wins + losses
    return 1.0 if not n else min(1.0, 2 * sum(math.comb(n, i) for i in range(min(wins, losses) + 1)) / 2**n)


def holm(tests: DataFrame, p: str = "p", order: str = "test", family: list[str] | None = None) -> DataFrame:
    """tests with p_holm, significant and family_size; the family is all rows, or those that agree in `family`."""
    by = Window.partitionBy(*(family or [F.lit(1)]))
    place = F.row_number().over(by.orderBy(p, order)) - 1
    out = tests.withColumn("family_size", F.count("*").over(by)).withColumn("__i", place)
    scaled = F.least(F.lit(1.0), (F.col("family_size") - F.col("__i")) * F.col(p))
    up_to = by.orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("p_holm", F.round(F.max(scaled).over(up_to), 6)).withColumn("significant", F.col("p_holm") < 0.05).drop("__i")


def bootstrap(pairs: DataFrame, by: str, item: str = "item_id", resamples: int = 5000, seed: int = 42) -> DataFrame:
    """Mean difference of each group with its 95 % percentile interval.

    Resampling draws from a group's differences in order of item, by a generator of its own seed, so that the interval
    does not hang on the order of rows. A comparison's items fit in a task.
    """

    def run(key, table):
        values = [d for _, d in sorted(zip(table.column(item).to_pylist(), table.column("diff").to_pylist(), strict=True))]
        rng, n = random.Random(seed), len(values)
        means = sorted(sum(rng.choices(values, k=n)) / n for _ in range(resamples))
        low, high = means[int(0.025 * resamples)], means[int(0.975 * resamples) - 1]
        return pa.table({by: pa.array([key[0].as_py()]), "n": pa.array([n]), "mean_diff": pa.array([sum(values) / n]), "low": pa.array([low]), "high": pa.array([high])})

    kind = pairs.schema[by].dataType.simpleString()
    return pairs.select(by, item, "diff").groupBy(by).applyInArrow(run, f"{by} {kind}, n long, mean_diff double, low double, high double")


#: Items of a block of a resampled group, about.
ITEMS = 10_000


def _stream(seed: int, *counter: int) -> np.random.Generator:
    """A generator that is a function of its counters alone."""
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, *counter])))


def resample_sums(values: np.ndarray, block: int, sizes: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """For each resample the sum of its draws from one block; sizes: items of all blocks.

    How many of a resample's draws fall to each block is drawn first, by a generator that all blocks have in common.
    """
    n, out = int(sizes.sum()), np.empty(resamples)
    for b in range(resamples):
        draws = int(_stream(seed, b).multinomial(n, sizes / n)[block]) if len(sizes) > 1 else n
        out[b] = values[_stream(seed, b, block + 1).integers(0, len(values), draws)].sum()
    return out


def bootstrap_blocks(pairs: DataFrame, by: str, item: str = "item_id", resamples: int = 5000, seed: int = 42, items: int = ITEMS) -> DataFrame:
    """by, n, mean_diff, low, high: as bootstrap(), for groups of any size.

    A group's items are dealt to blocks of about `items` by a hash of the item, and resampled a block a row. Draws are functions of
    (seed, resample, block), so that the interval does not hang on partitions or the order of rows; it does on `items`. Null
    differences are left out. Figures are rounded to 9 places, as sums of blocks come in any order.
    """
    own = pairs.where(F.col("diff").isNotNull()).select(F.col(by).alias("g"), F.col(item).alias("i"), F.col("diff").cast("double").alias("d"))
    n = own.groupBy("g").agg(F.count("*").alias("n"), F.avg("d").alias("mean"))
    number = F.ceil(F.col("n") / items).cast("long")
    dealt = own.join(n.select(F.col("g").alias("h"), "n"), F.col("g").eqNullSafe(F.col("h"))).withColumn("block", F.pmod(F.xxhash64("i", F.lit(seed)), number).cast("int"))
    blocks = Workspace(pairs.sparkSession).keep(dealt.groupBy("g", "block").agg(F.array_sort(F.collect_list(F.struct("i", "d"))).alias("v")))
    every = blocks.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("block", F.size("v").alias("size")))).alias("sizes"))
    rows = blocks.join(every.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h"))).select("g", F.array_position(F.transform("sizes", lambda s: s["block"]), F.col("block")).alias("at"), F.transform("v", lambda x: x["d"]).alias("v"), F.transform("sizes", lambda s: s["size"]).alias("sizes"))

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                sums = resample_sums(np.asarray(batch.column(2)[i].values), batch.column(1)[i].as_py() - 1, np.asarray(batch.column(3)[i].values), resamples, seed)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * resamples, batch.schema.field(0).type), pa.array(np.arange(resamples, dtype=np.int32)), pa.array(sums)], names=["g", "b", "s"])

    kind = dict(own.dtypes)["g"]
    spread_out = rows.repartition(pairs.sparkSession.sparkContext.defaultParallelism)  # a row is a block's work
    sums = spread_out.mapInArrow(run, f"g {kind}, b int, s double").groupBy("g", "b").agg(F.sum("s").alias("s"))
    place = F.row_number().over(Window.partitionBy("g").orderBy("s")) - 1  # as many rows a group as resamples
    ends = sums.withColumn("i", place).groupBy("g").agg(F.max(F.when(F.col("i") == int(0.025 * resamples), F.col("s"))).alias("low"), F.max(F.when(F.col("i") == int(0.975 * resamples) - 1, F.col("s"))).alias("high"))
    both = n.join(ends.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h")))
    return both.select(F.col("g").alias(by), "n", F.round("mean", 9).alias("mean_diff"), F.round(F.col("low") / F.col("n"), 9).alias("low"), F.round(F.col("high") / F.col("n"), 9).alias("high"))


def prefix_means(pairs: DataFrame, sizes: tuple[int, ...] = (15, 30), item: str = "item_id") -> DataFrame:
    """Mean difference of the first items by id, for each size and for all."""
    own = placed(pairs, [item], "__i", "__n").withColumn("size", F.explode(F.concat(F.array(*map(F.lit, sizes)), F.array(F.col("__n").cast("int")))))
    return own.where(F.col("__i") < F.col("size")).groupBy("size").agg(F.count("*").alias("n"), F.round(F.avg("diff"), DIGITS).alias("mean_diff"))


def largest_drops(pairs: DataFrame, item: str = "item_id", most: int = 5) -> DataFrame:
    """The items that lost most, ties by id."""
    return pairs.select(item, F.round("diff", DIGITS).alias("diff")).orderBy("diff", item).limit(most)


#: What an unequal mean of the arms means for a difference, by the track of its metric.
WARNINGS = {
    "retrieval": {"list_len": "measures length in part", "ctx_len": "measures length in part", "ceiling": "read the ratio to the ceiling"},
    "ragas": {"list_len": "measures length in part", "ctx_len": "favours the longer arm", "ceiling": "read the ratio to the ceiling"},
    "answer": {"k": "other denominator"},
}


def length_warnings(base: DataFrame, other: DataFrame, track: str = "retrieval", item: str = "item_id") -> DataFrame:
    """column, base_mean, other_mean, warns, meaning: what differs between the arms over their common items, so that a difference
    of quality is in doubt.

    Which columns count hangs on the track; an answer is judged by its text, so only its number of key points does. A mean is over
    the items that have a value, and an arm without any warns of nothing.
    """
    columns = WARNINGS[track]
    a = base.select(item, *(F.col(c).alias(f"a_{c}") for c in columns))
    b = other.select(item, *(F.col(c).alias(f"b_{c}") for c in columns))
    means = a.join(b, item).agg(*(F.avg(c).alias(c) for x in columns for c in (f"a_{x}", f"b_{x}")))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.round(f"a_{c}", DIGITS).alias("base_mean"), F.round(f"b_{c}", DIGITS).alias("other_mean"), F.coalesce(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) > TIE, F.lit(False)).alias("warns"), F.lit(m).alias("meaning")) for c, m in columns.items()))
    return means.select(F.explode(rows).alias("r")).select("r.*")


def sweep(spark: SparkSession, pairs: DataFrame, metrics: tuple[str, ...], by: str = "test") -> DataFrame:
    """One row for each metric: its difference, p and Holm's p among the metrics that have any pair. The others are unscored:
    no part of the family, but not left out of the report."""
    scored = difference(pairs.where(F.col(by).isin(*metrics)), [by]).withColumn("p", F.round(sign_p(F.col("wins"), F.col("losses")), 6))
    asked = spark.createDataFrame([(m,) for m in metrics], f"{by} string")
    return asked.join(holm(scored, order=by), by, "left").withColumn("unscored", F.col("n").isNull())


def kappa(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """Two-by-two table of two verdicts, observed and expected agreement and Cohen's kappa; NULL where it is undefined.
    Rows with a missing verdict are counted apart."""
    ok = a.isNotNull() & b.isNotNull()
    t = rows.agg(
        F.count_if(ok & a & b).alias("both"), F.count_if(ok & a & ~b).alias("only_a"), F.count_if(ok & ~a & b).alias("only_b"), F.count_if(ok & ~a & ~b).alias("neither"), F.count_if(~ok).alias("left_out")
    ).withColumn("n", F.expr("both + only_a + only_b + neither"))
    po = F.expr("(both + neither) / nullif(n, 0)")
    pe = F.expr("((both + only_a) * (both + only_b) + (neither + only_a) * (neither + only_b)) / nullif(n * n, 0)")
    return t.withColumn("agreement", F.round(po, DIGITS)).withColumn("kappa", F.round((po - pe) / F.nullif(1 - pe, F.lit(0.0)), DIGITS))


def flips(before: DataFrame, after: DataFrame, item: str = "item_id", verdict: str = "verdict") -> DataFrame:
    """Two audits: items judged in both, in one alone, changed verdicts, and agreement."""
    a = before.where(F.col(verdict).isNotNull()).select(item, F.col(verdict).alias("a"))
    b = after.where(F.col(verdict).isNotNull()).select(item, F.col(verdict).alias("b"))
    return a.join(b, item, "full").agg(
        F.count_if(F.expr("a is not null and b is not null")).alias("both"), F.count_if(F.expr("b is null")).alias("only_before"), F.count_if(F.expr("a is null")).alias("only_after"), F.count_if(F.expr("a <> b")).alias("flips"),
        F.round(F.avg(F.expr("cast(a = b as int)")), DIGITS).alias("agreement"),
    )


def report(rows: DataFrame) -> str:
    """A comparison as text; for a handful of rows."""
    return "\n".join(f"{r.test}: {r.mean_base:.4f} -> {r.mean_other:.4f} ({r.mean_diff:+.4f}), {r.wins}/{r.losses}/{r.ties}, p {r.p:.4f}, Holm {r.p_holm:.4f}" for r in rows.orderBy("test").collect())

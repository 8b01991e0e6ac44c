"""Bounded evidence loops and summaries of contexts, from what was recorded of the model's verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Why a loop stops, in the order in which the reasons are tried.
STOPS = ("judge_degraded", "sufficient", "token_budget", "steps_exhausted", "no_next_query", "no_new_evidence")


def stops(rounds: DataFrame, max_steps: int = 3, max_tokens: int = 6000) -> DataFrame:
    """(query_id, round, degraded, sufficient, prompt_tokens, next_query, fresh) -> query_id, stop_round, stop_reason, used_tokens.

    Rounds beyond the stop are not read. A record that ends without a reason has used its steps.
    """
    by = Window.partitionBy("query_id").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.coalesce("prompt_tokens", F.lit(0))).over(by)
    reason = (
        F.when(F.col("degraded"), STOPS[0]).when(F.col("sufficient"), STOPS[1]).when(F.col("used_tokens") >= max_tokens, STOPS[2]).when(F.col("round") >= max_steps, STOPS[3])
        .when(F.coalesce(F.trim("next_query"), F.lit("")) == "", STOPS[4]).when(F.coalesce("fresh", F.lit(0)) == 0, STOPS[5])
    )
    rows = rounds.withColumn("used_tokens", used).withColumn("reason", reason)
    first = F.min(F.when(F.col("reason").isNotNull(), F.struct("round", "reason", "used_tokens")))
    last = F.max(F.struct("round", F.lit(STOPS[3]).alias("reason"), "used_tokens"))
    out = rows.groupBy("query_id").agg(F.coalesce(first, last).alias("s"))
    return out.select("query_id", F.col("s.round").alias("stop_round"), F.col("s.reason").alias("stop_reason"), F.col("s.used_tokens").alias("used_tokens"))


def union_of_rounds(found: DataFrame, ends: DataFrame) -> DataFrame:
    """(query_id, round, chunk_id, score) up to each query's stop: each chunk once, where it came first, the best score first.
    Chunks read around others have no score and come last."""
    own = found.join(ends.select("query_id", "stop_round"), "query_id").where(F.col("round") <= F.col("stop_round"))
    once = own.groupBy("query_id", "chunk_id").agg(F.min(F.struct("round", "score")).alias("s")).select("query_id", "chunk_id", "s.round", F.coalesce("s.score", F.lit(0.0)).alias("score"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "round", "chunk_id")))


def routed(aggregate: Column, date_filter: Column) -> Column:
    """The type of a question by its plan."""
    return F.when(~aggregate, "single").when(date_filter, "time_filter").otherwise("cross_doc")


def summary_context(summaries: Column, docs: Column, pages: Column) -> Column:
    """Summaries (nos array<int>, text) -> one text, each under the numbers of its blocks and the place of the first of them."""

    def part(s: Column) -> Column:
        at = F.get(s["nos"], F.lit(0)) - 1
        page = F.get(pages, at)
        where = F.when(page.isNotNull(), F.concat(F.lit("（"), F.get(docs, at), F.lit(" 第"), page.cast("string"), F.lit("页）"))).otherwise(F.concat(F.lit("（"), F.get(docs, at), F.lit("）")))
        return F.concat(F.array_join(F.transform(s["nos"], lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), ""), F.lit(" "), where, F.lit("\n"), s["text"])

    return F.array_join(F.transform(summaries, part), "\n\n")


def replayed_context(summaries: Column, blocks: Column) -> Column:
    """The same from the stored texts of the blocks, whose first line begins with number and place."""

    def part(s: Column) -> Column:
        line = F.get(F.split(F.get(blocks, F.get(s["nos"], F.lit(0)) - 1), "\n"), F.lit(0))
        place = F.regexp_replace(line, r"^\[[0-9]+\] ", "")
        return F.concat(F.array_join(F.transform(s["nos"], lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), ""), F.lit(" "), place, F.lit("\n"), s["text"])

    return F.array_join(F.transform(summaries, part), "\n\n")

"""The request log: latency, service levels, rate limits, caches, counters."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from sparrowdoc.operators import metrics as M
from sparrowdoc.plans.catalogue import query
from sparrowdoc.sources import tables
from sparrowdoc.sources.shared import Workspace
from sparrowdoc.streaming import live
from sparrowdoc.streaming.sink import ItemSink


@query("""SELECT event_type, count(value) AS n, round(quantile_disc(value, 0.5), 1) AS p50, round(quantile_disc(value, 0.95), 1) AS p95 FROM events GROUP BY 1""")
def latency_quantiles(spark, t):
    q = M.exact_quantiles(t("events"), ["event_type"], "value", {"p50": 50, "p95": 95})
    return q.withColumns({c: F.round(c, 1) for c in ("p50", "p95")})


@query("""WITH e AS (SELECT *, user_id % 97 = 0 AND event_type <> 'click' AS cached, CASE WHEN event_type = 'click' THEN 50 ELSE 80 END AS lim FROM events)
SELECT event_type, count(value) AS n, count(*) FILTER (cached) AS n_cached, round(quantile_disc(value, 0.5), 1) AS p50, round(quantile_disc(value, 0.95), 1) AS p95, round(quantile_disc(CASE WHEN NOT cached THEN value END, 0.95), 1) AS uncached_p95,
  max(lim) AS limit_ms, CASE WHEN count(value) > 0 AND count(*) FILTER (cached) = 0 THEN round(quantile_disc(value, 0.95), 1) <= max(lim) END AS meets FROM e GROUP BY 1""")
def latency_slo(spark, t):
    return M.latency_summary(t("events"), "event_type", "value", F.expr("user_id % 97 = 0 and event_type <> 'click'"), F.expr("case when event_type = 'click' then 50 else 80 end"))


@query("""WITH e AS (SELECT *, CASE event_type WHEN 'click' THEN 'cross_doc' WHEN 'view' THEN 'time_filter' ELSE event_type END AS kind, user_id % 97 = 0 AS cached FROM events), b AS (SELECT *, CASE WHEN kind IN ('cross_doc', 'time_filter') THEN 'aggregate' ELSE 'short' END AS bucket FROM e)
SELECT bucket, CASE bucket WHEN 'aggregate' THEN 5000 ELSE 8000 END AS target_ms, count(CASE WHEN NOT cached THEN value END) AS n_uncached, round(quantile_disc(CASE WHEN NOT cached THEN value END, 0.95), 1) AS p95,
  CASE WHEN NOT (SELECT bool_or(cached) FROM b) THEN round(quantile_disc(CASE WHEN NOT cached THEN value END, 0.95), 1) <= CASE bucket WHEN 'aggregate' THEN 5000 ELSE 8000 END END AS meets FROM b GROUP BY bucket""")
def latency_targets(spark, t):
    rows = t("events").withColumn("kind", F.expr("case event_type when 'click' then 'cross_doc' when 'view' then 'time_filter' else event_type end"))
    return M.latency_targets(rows, "kind", "value", F.expr("user_id % 97 = 0"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT event_type, count(*) AS n, round(quantile_disc(value, 0.95), 1) AS p95 FROM r WHERE n <= 500 GROUP BY 1""")
def last_500_p95(spark, t):
    return M.last_samples(t("events"), "event_type", ["ts", "event_id"]).groupBy("event_type").agg(F.count("*").alias("n"), M.nearest_rank("value", 95).alias("p95"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, min(value) AS q FROM r WHERE i = n // 2 GROUP BY 1""")
def upper_median(spark, t):
    return M.picked_quantile(t("events"), ["event_type"], "value", F.floor(F.col("n") / 2))


@query()
def rate_limit_admission(spark, t):
    """Admissions with state: a rejected call leaves no trace, so no window frame says it; a test holds it against a plain limiter."""
    return live.admissions(t("events"), "event_type", "ts", "event_id", 5)


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY ALL""")
def hourly_quantiles(spark, t):
    return live.hourly_quantiles(t("events"), "ts", "value", "event_type")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS calls FROM g GROUP BY user_id, s""")
def user_sessions(spark, t):
    return live.sessions(t("events"), "user_id", "ts", "6 hours")


@query("""SELECT event_type AS model, count(*) AS entries, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1""")
def cache_inventory(spark, t):
    return tables.cache_inventory(t("events").select(F.col("event_type").alias("model"), F.col("ts").alias("created_at")))


@query("""SELECT count(*) FILTER (event_type = 'click') AS hits, count(*) FILTER (event_type = 'view') AS misses, round(count(*) FILTER (event_type = 'click') / nullif(count(*) FILTER (event_type IN ('click', 'view')), 0), 4) AS hit_rate FROM events""")
def cache_hit_rate(spark, t):
    return M.hit_rate(t("events"), F.col("event_type") == "click", F.col("event_type") == "view")


@query("""WITH d AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 100) SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM d)""")
def incomplete_streams(spark, t):
    e = t("events")
    return live.incomplete(e.where("event_type = 'click'").select("user_id").distinct(), e.where("event_type = 'purchase' and value > 100"), "user_id")


@query("""SELECT user_id, ts FROM events a WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'purchase' AND b.user_id = a.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 DAY)""")
def unfinished_clicks(spark, t):
    """Clicks without a purchase of the user within a day after them."""
    e = t("events")
    return live.unfinished(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), "user_id", "ts", "1 day")


@query("SELECT item_id, len(text) AS n_chars, CASE WHEN item_id % 5 = 0 THEN 'b' ELSE 'a' END AS run FROM benchmark")
def per_item_results(spark, t):
    """A run that is broken off and called again, and a second one for the items that had errors."""
    sink, broken = ItemSink(spark, Workspace(spark).path("items"), "item_id"), []

    def work(rows, errors=True):
        if errors and not broken and sink.results() is not None:
            broken.append(1)
            raise RuntimeError("broken off")
        return rows.select("item_id", F.length("text").cast("long").alias("n_chars"), F.expr("case when item_id % 5 = 0 then 'no answer' end" if errors else "cast(null as string)").alias("error"))

    for _ in range(2):
        try:
            sink.run("a", t("benchmark"), work, 4)
        except StreamingQueryException:
            continue
    sink.run("b", t("benchmark"), lambda rows: work(rows, False), 2)
    return sink.best().select("item_id", "n_chars", "run")


@query("""SELECT 'requests{kind="' || event_type || '",route="r' || (user_id % 3) || '"}' AS metric, count(*) AS value FROM events GROUP BY 1""")
def request_counters(spark, t):
    labels = F.create_map(F.lit("route"), F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")), F.lit("kind"), F.col("event_type"))
    return live.counters(t("events").withColumn("labels", labels), "requests", "labels")

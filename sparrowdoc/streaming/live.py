"""The request log as a stream: rate limiting with exact state, rolling quantiles; and their batch twins."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowdoc.operators.metrics import exact_quantiles

WINDOW_S = 60.0


class Limiter:
    """Admits a call if fewer than `limit` admitted ones lie in the window before it; a rejected call leaves no trace."""

    def __init__(self, limit: int, window: float = WINDOW_S, admitted: Iterator[float] = ()):
        self.limit, self.window, self.admitted = limit, window, deque(admitted)

    def admits(self, at: float) -> bool:
        while self.admitted and at - self.admitted[0] > self.window:
            self.admitted.popleft()
        if len(self.admitted) >= self.limit:
            return False
        self.admitted.append(at)
        return True


def admissions(log: DataFrame, key: str, ts: str, order: str, limit: int, window: float = WINDOW_S) -> DataFrame:
    """(key, order) with admitted for each call. Calls of a key are read in order, streamed through one limiter of it."""
    rows = log.select(F.col(key).alias("key"), F.col(order).alias("no"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches):
        last, own = object(), None
        for batch in batches:
            out = []
            for k, at in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if own is None or k != last:
                    last, own = k, Limiter(limit, window)
                out.append(at is not None and own.admits(at / 1e6))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["key", "no", "admitted"])

    ordered = rows.repartition("key").sortWithinPartitions("key", "at", "no")
    return ordered.mapInArrow(run, f"key {kinds['key']}, no {kinds['no']}, admitted boolean").select(F.col("key").alias(key), F.col("no").alias(order), "admitted")


def admissions_stream(log: DataFrame, key: str, ts: str, order: str, limit: int, window: float = WINDOW_S, late: str | None = None) -> DataFrame:
    """The same on a stream; state is the admitted times of a key, at most `limit` of them.

    With `late`, calls may be so much behind the latest one, and a key whose last admitted call the watermark has left a
    window behind is forgotten: no later call can meet it. Without, keys are kept for ever.
    """
    timed = log.withWatermark(ts, late) if late else log
    rows = timed.select(F.col(key).alias("key"), F.col(order).alias("no"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), *([F.col(ts).alias("ts")] if late else []))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def step(k, frames, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        own = Limiter(limit, window, state.get[0] if state.exists else ())
        calls = pd.concat(list(frames)).sort_values(["at", "no"])
        admitted = [own.admits(at / 1e6) for at in calls["at"]]
        state.update((list(own.admitted),))
        if late:
            last = own.admitted[-1] if own.admitted else 0
            state.setTimeoutTimestamp(max(int((last + window) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": calls["key"], "no": calls["no"], "admitted": admitted})

    return rows.groupBy("key").applyInPandasWithState(step, f"key {kinds['key']}, no {kinds['no']}, admitted boolean", "admitted array<double>", "append", "EventTimeTimeout" if late else "NoTimeout")


def rolling_quantiles(log: DataFrame, ts: str, value: str, by: str, width: str = "1 hour", slide: str | None = None, late: str | None = "10 minutes") -> DataFrame:
    """Count and approximate p50 and p95 of each window; on a stream with a watermark. Exact in the batch twin below."""
    rows = log.withWatermark(ts, late) if late and log.isStreaming else log
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return rows.groupBy(w.alias("w"), by).agg(F.count(value).alias("n"), F.percentile_approx(value, F.array(F.lit(0.5), F.lit(0.95)), 10_000).alias("q")).select(F.col("w.start").alias("window_start"), by, "n", F.get("q", F.lit(0)).alias("p50"), F.get("q", F.lit(1)).alias("p95"))


def hourly_quantiles(log: DataFrame, ts: str, value: str, by: str) -> DataFrame:
    """Nearest-rank quantiles by hour, exact."""
    return exact_quantiles(log.withColumn("window_start", F.date_trunc("hour", ts)), ["window_start", by], value, {"p50": 50, "p95": 95})


def sessions(log: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    """Calls of a key with no longer gap between them."""
    rows = log.withWatermark(ts, late) if late and log.isStreaming else log
    return rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("calls")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "calls")


def incomplete(started: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Streams that began and never ended."""
    return started.join(done.select(key).distinct(), key, "left_anti")


def unfinished(started: DataFrame, done: DataFrame, key: str, ts: str, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(key, ts) of what began and did not end `within` the time after it.

    Both sides may be streams: each row then waits in state for its other half until the watermark, `late` behind the latest
    times of both, has passed the time that it has, and goes; so the state holds the open rows alone. On tables it is the same
    join. Rows with a null key or time take no part in a stream's result.
    """
    a, b = (rows.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias(f"{side}_key"), F.col(ts).alias(f"{side}_ts")) for rows, side in ((started, "a"), (done, "b")))
    if a.isStreaming:
        a, b = a.withWatermark("a_ts", late), b.withWatermark("b_ts", late)
    both = a.join(b, (F.col("a_key") == F.col("b_key")) & (F.col("b_ts") >= F.col("a_ts")) & (F.col("b_ts") <= F.col("a_ts") + F.expr(f"interval {within}")), "left_outer")
    return both.where("b_key is null").select(F.col("a_key").alias(key), F.col("a_ts").alias(ts))


def counters(log: DataFrame, name: str, labels: str) -> DataFrame:
    """Events by rendered metric key."""
    from sparrowdoc.functions.text import metric_key

    return log.groupBy(metric_key(F.lit(name), F.col(labels)).alias("metric")).agg(F.count("*").alias("value"))

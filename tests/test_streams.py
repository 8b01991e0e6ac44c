"""Streams that let their state go, and results that survive a broken run."""

from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from sparrowdoc.streaming import live
from sparrowdoc.streaming.sink import ItemSink

START = datetime(2024, 1, 1)
CALL = "k string, no long, ts timestamp"


def at(minutes):
    return START + timedelta(minutes=minutes)


def fed(spark, root, parts, schema):
    """A stream of one batch for each part."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(root / f"part={i}"))
    return spark.readStream.schema(f"{schema}, part int").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(root)).drop("part")


def ran(spark, df, name, root):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(root / f"cp-{name}")).trigger(processingTime="0 seconds").start()
    q.processAllAvailable()
    state = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in q.recentProgress if p["stateOperators"]]
    q.stop()
    return spark.table(name), state


def test_unfinished(spark, tmp_path):
    """The stream gives its batch twin's rows, and no open row is left when the watermark has passed them."""
    begun = [[("a", 1, at(0)), ("b", 2, at(5)), ("a", 3, at(50)), (None, 4, at(1)), ("d", 5, None)], [("c", 6, at(70))], [("z", 7, at(600))], [("z", 8, at(601))]]
    ended = [[("a", 1, at(20)), ("b", 2, at(90))], [("c", 3, at(75)), ("x", 4, at(76))], [("z", 5, at(602))], [("z", 6, at(603))]]
    (tmp_path / "s").mkdir()
    a, b = fed(spark, tmp_path / "a", begun, CALL), fed(spark, tmp_path / "b", ended, CALL)
    got, state = ran(spark, live.unfinished(a, b, "k", "ts", "30 minutes", "10 minutes"), "unfinished", tmp_path / "s")
    tables = [spark.createDataFrame([r for part in x for r in part], CALL) for x in (begun, ended)]
    want = sorted((r.k, r.ts) for r in live.unfinished(*tables, "k", "ts", "30 minutes").collect())
    assert sorted((r.k, r.ts) for r in got.collect()) == want == [("a", at(50)), ("b", at(5))]
    assert max(state) >= 4 and state[-1] <= 4  # the last hour's z alone


def test_idle_keys_go(spark, tmp_path):
    """Keys whose window has passed are forgotten; what is admitted stays as it was."""
    parts = [[(f"k{i}", i, at(i / 100)) for i in range(40)] + [("k1", 100, at(0.2))], [("late", 200, at(300))], [("late", 201, at(301))], [("late", 202, at(302))]]
    (tmp_path / "s").mkdir()
    stream = live.admissions_stream(fed(spark, tmp_path / "a", parts, CALL), "k", "ts", "no", 1, 60.0, late="10 minutes")
    got, state = ran(spark, stream, "admitted_idle", tmp_path / "s")
    batch = live.admissions(spark.createDataFrame([r for p in parts for r in p], CALL), "k", "ts", "no", 1, 60.0)
    assert sorted((r.no, r.admitted) for r in got.collect()) == sorted((r.no, r.admitted) for r in batch.collect())
    assert max(state) >= 40 and state[-1] == 1


def test_broken_run(spark, tmp_path):
    """A run that is killed between items and called again gives what a whole one gives; flushed items are not worked off again."""
    items = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "id long, text string")
    seen, sink = [], ItemSink(spark, str(tmp_path / "sink"), "id")

    def work(rows, stop=True):
        ids = [r.id for r in rows.collect()]
        if stop and len(seen) > 10:
            raise RuntimeError("killed")
        seen.extend(ids)
        return rows.select("id", F.upper("text").alias("answer"), F.expr("case when id % 10 = 3 then 'timeout' end").alias("error"))

    with pytest.raises(StreamingQueryException):
        sink.run("one", items, work, 5)
    part = sink.results().count()
    assert 10 < part < 40
    done = sink.run("one", items, lambda rows: work(rows, False), 5)
    assert sorted(seen) == list(range(40)) and done.count() == 40
    assert sorted(r.id for r in sink.todo(items).collect()) == [3, 13, 23, 33]
    sink.run("one", items, lambda rows: work(rows, False), 5)
    assert sorted(seen) == list(range(40))  # a finished run has nothing to do
    sink.run("two", items, lambda rows: rows.select("id", F.lit("late").alias("answer"), F.expr("case when id = 3 then 'again' end").alias("error")), 2)
    best = {r.id: (r.answer, r.error, r.run) for r in sink.best().collect()}
    assert len(best) == 40 and best[3] == ("late", "again", "two") and best[13] == ("late", None, "two") and best[4] == ("TEXT 4", None, "one")

"""Keyed tables by bucket, and the inverted index."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparrowdoc.operators import inverted, retrieve
from sparrowdoc.operators.inverted import InvertedIndex
from sparrowdoc.sources.store import KeyedTable

SCHEMA = "k long, v string, n int"


def files(root):
    return {str(p): (p.stat().st_mtime_ns, p.stat().st_size) for p in Path(root).rglob("*.parquet")}


def content(table):
    return sorted(map(tuple, table.read().collect()), key=str)


def test_updates_touch_their_buckets(spark, tmp_path):
    rows = [(i, f"v{i}", i) for i in range(500)] + [(None, "no key", 1), (None, "no key", 1), (7, "twice", 0)]
    table = KeyedTable(spark, str(tmp_path / "t"), "k", 32).create(spark.createDataFrame(rows, SCHEMA))
    assert content(table) == sorted(rows, key=str)
    before = files(tmp_path)
    new = spark.createDataFrame([(7, "new", 1), (7, "newer", 2), (1000, "more", 1), (None, "left out", 1)], SCHEMA)
    for _ in range(2):  # once more changes nothing
        table.upsert(new, order="n")
        rows = [r for r in rows if r[0] not in (7, 1000)] + [(7, "newer", 2), (1000, "more", 1)]
        assert content(table) == sorted(rows, key=str)
    after = files(tmp_path)
    kept = [p for p in before if after.get(p) == before[p]]
    touched = {r[0] for r in spark.createDataFrame([(7,), (1000,)], "k long").select(table.bucket()).collect()}
    assert all(int(p.split("bucket=")[1].split("/")[0]) in touched for p in before if p not in kept and "bucket=" in p) and len(kept) > 25
    table.delete(spark.createDataFrame([(i,) for i in range(0, 500, 100)] + [(None,), (99_999,)], "k long"))
    rows = [r for r in rows if r[0] is None or r[0] % 100 or r[0] == 1000]
    assert content(table) == sorted(rows, key=str)
    table.backfill(spark.createDataFrame([(1, "filled"), (2, None), (99_998, "none")], "k long, v string"), ["v"])
    assert content(table) == sorted([(k, "filled" if k == 1 else v, n) for k, v, n in rows], key=str)


def test_all_rows_go(spark, tmp_path):
    """Buckets without rows are removed; a table without any is still one."""
    rows = spark.createDataFrame([(i, "v", i) for i in range(20)], SCHEMA)
    table = KeyedTable(spark, str(tmp_path / "t"), "k", 4).create(rows)
    table.delete(rows)
    assert content(table) == [] and table.exists() and table.lookup(rows).count() == 0
    table.upsert(rows)
    assert table.read().count() == 20
    assert KeyedTable(spark, str(tmp_path / "e"), "k").create(rows.where("false")).read().dtypes == rows.dtypes
    table.upsert(rows.where("false"))
    table.delete(rows.where("false"))
    table.backfill(rows.where("false"), ["v"])
    assert table.read().count() == 20


def scanned(df):
    """Rows and files that the scans of a collected plan gave."""
    found, todo = [0, 0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        if plan.nodeName().startswith("Scan parquet"):
            found = [found[0] + plan.metrics().apply("numOutputRows").value(), found[1] + plan.metrics().apply("numFiles").value()]
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return found


def test_lookup_reads_few_row_groups(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    table = KeyedTable(spark, str(tmp_path / "t"), "doc_id", 2, row_group_bytes=1 << 12).create(docs)
    asked = spark.createDataFrame([(3,), (500,), (10**12,), (None,)], "doc_id long")
    found = table.lookup(asked)
    assert sorted(r.doc_id for r in found.collect()) == [3, 500]
    rows, _ = scanned(found)
    assert 0 < rows < docs.count() / 2
    assert table.lookup(docs.select("doc_id").union(docs.select(F.col("doc_id") + 5000))).count() == docs.count()


def rows_of(df):
    return sorted((r.query_id, r.rank, r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize("k", [1, 3, 10])
def test_blocks_are_skipped(spark, monkeypatch, tmp_path, k):
    """A term that all documents have is read as far as it matters, and results are those of bm25_topk."""
    monkeypatch.setattr(inverted, "BLOCK", 4)
    texts = [(i, "common " * (1 + i % 3) + f"word{i % 20} " * (i % 5) + " ".join(f"fill{i}x{j}" for j in range(i % 40))) for i in range(600)]
    docs = spark.createDataFrame([*texts, (None, "common word1"), (601, None), (602, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "common word7"), (2, "common"), (3, "nothing here"), (4, ""), (5, "word3 word4 common common"), (None, "common"), (6, None)], "query_id long, query string")
    index = InvertedIndex(spark, str(tmp_path / "i"), 4).create(docs)
    found, counts = index.search(asked, k)
    assert rows_of(found) == rows_of(retrieve.bm25_topk(docs, asked, k))
    read = {r.query_id: (r.blocks, r.read) for r in counts.collect()}
    assert read[1][1] < read[1][0] and all(b <= a for a, b in read.values())
    folders = {p.split("/postings/")[1].rsplit("/", 1)[0] for p in files(tmp_path / "i/postings")}
    assert len({f.split("bucket=")[1].split("/")[0] for f in folders}) > 1
    plan = index.search(asked.where("query_id = 2"), k)[0]
    plan.collect()
    explained = spark._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "formatted")
    assert "PartitionFilters" in explained and "bucket" in explained


def test_index_updates(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"alpha w{i % 7} w{i % 11}") for i in range(80)], "doc_id long, text string")
    new = spark.createDataFrame([(3, "alpha alpha beta"), (3, "alpha alpha beta"), (500, "beta w3"), (None, "beta")], "doc_id long, text string")
    gone = spark.createDataFrame([(4,), (4,), (5,), (999,)], "doc_id long")
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "w3 w4"), (3, "beta")], "query_id long, query string")
    index = InvertedIndex(spark, str(tmp_path / "i"), 4).create(docs)
    index.upsert(new)
    index.delete(gone)
    want = docs.where("doc_id not in (3, 4, 5)").union(new.where("doc_id is not null").distinct())
    assert rows_of(index.search(asked, 5)[0]) == rows_of(retrieve.bm25_topk(want, asked, 5))
    allowed = want.where("doc_id % 2 = 1")
    assert rows_of(index.search(asked, 5, allowed=allowed)[0]) == rows_of(retrieve.bm25_topk(want, asked, 5, F.col("doc_id") % 2 == 1))
    assert not os.path.exists(InvertedIndex(spark, str(tmp_path / "j"), 4).create(want).path + "/dead")
    index.compact(want)
    assert rows_of(index.search(asked, 5, own=False)[0]) == rows_of(retrieve.bm25_topk(want, asked, 5, own=False))
    empty = InvertedIndex(spark, str(tmp_path / "e"), 4).create(docs.where("false"))
    assert empty.search(asked, 5)[0].count() == 0


def test_filtered_documents_are_scored_whole(spark, tmp_path):
    """A join by document that turns into a broadcast once its tables are known: a document's postings, read by several tasks, still
    meet in one."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 23}" for k in range(1, 12))) for i in range(300)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, " ".join(f"w{(i + j) % 23}" for j in range(8))) for i in range(20)], "query_id long, query string")
    index = InvertedIndex(spark, str(tmp_path / "i"), 4).create(docs)
    want = rows_of(retrieve.bm25_topk(docs, asked, 5, F.col("doc_id") % 3 == 1))
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB", "spark.sql.files.maxPartitionBytes": "4KB", "spark.sql.files.openCostInBytes": "1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        assert rows_of(index.search(asked, 5, allowed=docs.where("doc_id % 3 = 1"))[0]) == want
    finally:
        for k in own:
            spark.conf.unset(k)

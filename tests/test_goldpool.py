"""The pool of items: what is made and drawn, and each check with a planted violation."""

import pytest

from sparrowdoc.operators import goldpool
from sparrowdoc.operators.chunk import chunk_by

FACT = "doc_id long, fact_no int, title string, topic string, status string, key string, text string, kind string, row string, year int"
SMALL = {"cross_doc": 1, "time_filter": 1}


@pytest.fixture(scope="module")
def made(spark):
    texts = [
        (1, "Pumps cost 120 euro. Reported by Anna7 in 2021. Code BLUE."), (2, "Pumps cost 140 euro. Reported by Anna7 in 2022."),
        (3, "Wells cost 9 euro. Code BLUE."), (4, "Wells cost 11 euro, more\nthan before."), (5, "Wells: no decision."), (6, None), (7, "wires"),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    facts = [
        (1, 0, "a", "Pumps", "decided", "120 euro", "Pumps cost 120 euro. Reported", None, None, 2021), (2, 0, "b", "Pumps", "overturned", "140 euro", "Pumps cost 140 euro", "table", "Pumps", 2022),
        (3, 0, "c", "Wells", "decided", "9 euro", "Wells cost 9 euro. Code", None, None, 2021), (4, 0, "d", "Wells", "decided", "11 euro", "Wells cost 11 euro, more", "scan", None, 2021), (5, 0, "e", "Wells", "open", None, "Wells: no decision", None, None, 2021),
    ]
    series = spark.createDataFrame([("Pumps", "Anna7", 1), ("Pumps", "Anna7", 2)], "topic string, owner string, doc_id long")
    absent = spark.createDataFrame([("parking",), ("parking",)], "term string")
    codes = spark.createDataFrame([("wells and pumps", "BLUE")], "topic string, code string")
    pool = goldpool.build(spark.createDataFrame(facts, FACT), codes, series, absent, docs)
    return pool, docs


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def found(pool, docs, chunks=None, **more):
    return rows(goldpool.violations(pool, docs, docs if chunks is None else chunks, least=more.pop("least", SMALL), **more), "check", "item_id", "doc_id", "n")


def test_what_is_made(made):
    pool, _ = made
    assert rows(pool.items, "item_id") == [(x,) for x in ("cross_doc:Pumps", "cross_doc:topic:Wells", "decision:2:0", "decision:4:0", "fact:1:0", "fact:3:0", "no_answer:parking", "open_discussion:5:0", "term:BLUE", "time_filter:Pumps:2021", "time_filter:Pumps:2022")]
    assert rows(pool.sources.where("item_id in ('term:BLUE', 'cross_doc:topic:Wells', 'time_filter:Pumps:2022')"), "item_id", "doc_id") == [("cross_doc:topic:Wells", 3), ("cross_doc:topic:Wells", 4), ("cross_doc:topic:Wells", 5), ("term:BLUE", 1), ("term:BLUE", 3), ("time_filter:Pumps:2022", 2)]
    assert rows(pool.points.where("item_id like 'cross%'"), "item_id", "no", "doc_id", "phrase") == [("cross_doc:Pumps", 1, 1, "Pumps cost 120 euro"), ("cross_doc:Pumps", 2, 2, "Pumps cost 140 euro"), ("cross_doc:topic:Wells", 1, 3, "Wells cost 9 euro"), ("cross_doc:topic:Wells", 2, 4, "Wells cost 11 euro, more")]
    assert [r.refusable for r in pool.items.where("type = 'no_answer'").collect()] == [True]


def test_sound_pool_and_real_chunks(made):
    pool, docs = made
    assert found(pool, docs) == []
    assert found(pool, docs, chunk_by("structural", docs)) == []


def test_planted(spark, made):
    pool, docs = made
    gone = docs.where("doc_id <> 2")
    assert found(pool, gone) == [("unknown source", "cross_doc:Pumps", 2, 1), ("unknown source", "decision:2:0", 2, 1), ("unknown source", "time_filter:Pumps:2022", 2, 1)]
    changed = docs.selectExpr("doc_id", "case when doc_id = 3 then 'Wells cost 90 euro. Code BLUE.' else text end as text")
    assert found(pool, changed) == [("not in chunks", "cross_doc:topic:Wells", 3, 1), ("not in chunks", "fact:3:0", 3, 1), ("not in text", "cross_doc:topic:Wells", 3, 1), ("not in text", "fact:3:0", 3, 1)]
    assert found(pool, docs, changed) == [("not in chunks", "cross_doc:topic:Wells", 3, 1), ("not in chunks", "fact:3:0", 3, 1)]
    more = docs.union(spark.createDataFrame([(8, "Anna7 likes par king"), (9, "We lls")], docs.schema))
    assert found(pool, more) == [("found elsewhere", "cross_doc:Pumps", 8, 1), ("found elsewhere", "cross_doc:topic:Wells", 9, 1), ("found elsewhere", "no_answer:parking", 8, 1)]
    assert found(pool, docs, least={"term": 2, "none": 1}) == [("too few", "none", None, 0), ("too few", "term", None, 1)]
    twice = goldpool.Pool(pool.items.union(pool.items.where("type = 'term'")), pool.phrases, pool.sources.where("item_id <> 'fact:1:0'"), pool.points.where("item_id <> 'cross_doc:Pumps'"))
    assert found(twice, docs) == [("no source", "fact:1:0", None, 1), ("points", "cross_doc:Pumps", None, 1), ("repeated id", "term:BLUE", None, 2)]
    assert found(pool, docs.where("doc_id <> 7").selectExpr("doc_id", "if(doc_id = 4, '', text) as text"), scanned=docs.where("doc_id = 4")) == [("found elsewhere", "cross_doc:topic:Wells", 4, 1), ("not in chunks", "cross_doc:topic:Wells", 4, 1), ("not in text", "cross_doc:topic:Wells", 4, 1), ("to be read", "decision:4:0", None, 1)]


def test_sets(spark, made):
    pool, docs = made
    small, large = goldpool.drawn(pool, {"fact": 1, "decision": 1, "no_answer": 3}), goldpool.drawn(pool, {"fact": 2, "decision": 2, "no_answer": 3, "term": 1})
    assert rows(small.items, "item_id", "type") == [("q001", "fact"), ("q002", "decision"), ("q003", "no_answer")]
    assert set(rows(small.items, "question")) <= set(rows(large.items, "question")) and large.items.count() == 6
    assert found(large, docs, least={}) == []
    first = goldpool.drawn(pool, {"decision": 1, "fact": 1}, floors={"scan": 1, "table": 1})
    assert first.items.count() == 2 and first.sources.count() == 2


def test_empty(spark, made):
    pool, docs = made
    facts, none = spark.createDataFrame([], FACT), docs.where("false")
    empty = goldpool.build(facts, spark.createDataFrame([], "topic string, code string"), spark.createDataFrame([], "topic string, owner string, doc_id long"), spark.createDataFrame([], "term string"), none)
    assert empty.items.count() == 0 and found(empty, none) == [("too few", "cross_doc", None, 0), ("too few", "time_filter", None, 0)]
    assert goldpool.drawn(empty, goldpool.CORE).items.count() == 0

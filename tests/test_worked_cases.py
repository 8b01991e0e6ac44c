"""Cases worked by hand: definitions, ties, NULLs, empty input."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sparrowdoc.functions import text as T
from sparrowdoc.operators import chunk, evidence, layout, metrics, mining, places, provenance, retrieve, robustness, stats
from sparrowdoc.sources import tables
from sparrowdoc.streaming import live


def one(spark, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema)


def results(spark, docs, query="q"):
    return spark.createDataFrame([(query, i, d) for i, d in enumerate(docs, 1)], "query_id string, rank int, doc_id string")


def gold(spark, docs, query="q"):
    return spark.createDataFrame([(query, d) for d in docs], "query_id string, doc_id string")


@pytest.mark.parametrize(("docs", "want", "expected"), [("A B C", "A", 1.0), ("X Y A", "A", 0.5), ("X A A A", "A", 0.6309), (" ".join("abcdefgh"), " ".join("abcdefgh") + " " + " ".join(f"g{i}" for i in range(52)), 1.0)])
def test_ndcg(spark, docs, want, expected):
    assert metrics.rank_metrics(results(spark, docs.split()), gold(spark, want.split())).first().ndcg_at_wide == expected


def test_rank_metrics(spark):
    r = metrics.rank_metrics(results(spark, "AXBAY"), gold(spark, "ABC")).first()
    assert (r.recall_at_k, r.precision_at_k, r.ap_at_k, r.n_list) == (0.6667, 0.4, 0.5556, 5)
    r = metrics.rank_metrics(results(spark, ["d1", "d2", "d1", "d3", "d4", "d5"]), gold(spark, ["d2", "d5"])).first()
    assert (r.recall_at_k, r.precision_at_k, r.ap_at_k) == (1.0, 0.4, 0.45)
    r = metrics.rank_metrics(results(spark, ["x"] * 8), gold(spark, [f"g{i}" for i in range(56)])).first()
    assert (r.ceiling, r.first_hit, r.recall_at_k) == (0.1429, None, 0.0)
    assert metrics.rank_metrics(results(spark, "A"), gold(spark, "").where("false")).count() == 0


def test_mean_reciprocal_rank(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 4), ("c", None)], "query_id string, first_hit int")
    for c in ("recall_at_k", "precision_at_k", "ap_at_k", "ndcg_at_k", "recall_at_list", "ceiling", "recall_vs_ceiling", "n_list"):
        rows = rows.withColumn(c, F.lit(1.0))
    assert metrics.retrieval_summary(rows).first().mrr == 0.4167


@pytest.mark.parametrize(("n", "p", "want"), [(19, 95, 19), (19, 50, 10), (21, 50, 11)])
def test_nearest_rank(spark, n, p, want):
    assert spark.range(1, n + 1).agg(metrics.nearest_rank("id", p).alias("q")).first().q == want


def test_rounding_ties_go_up(spark):
    assert spark.range(1).select(F.round(F.lit(0.28125), 4).alias("r")).first().r == 0.2813


@pytest.mark.parametrize(("name", "want"), [
    ("2025年36周", "2025-09-01"), ("2025年第44周", "2025-10-27"), ("2026年42周", "2026-10-12"), ("2025年第53周", "2025-12-31"), ("2020年53周", "2020-12-28"), ("2019年1周", "2019-01-01"), ("2021年1周", "2021-01-04"),
    ("2025年99周", None), ("20260901-x", "2026-09-01"), ("2026-9-1 x", "2026-09-01"), ("2026年9月1日x", "2026-09-01"), ("20261399.pdf", None), (None, None),
])
def test_dates_in_names(spark, name, want):
    assert one(spark, name).select(T.date_in_name("s").alias("d")).first().d == want


def test_text_forms(spark):
    r = one(spark, "a　b c​").select(T.squeeze("s").alias("a"), T.visible("s").alias("b"), T.normal_date(F.lit("2026-02-31")).alias("c"), T.phrase_form(F.lit("@a _b\\*")).alias("d")).first()
    assert (r.a, r.c, r.d) == ("abc​", "2026-02-31", "ab") and not r.b.endswith("​")
    r = one(spark, "a1b2c3").select(T.holds_in_order(F.lit("abc"), "s").alias("a"), T.holds_in_order(F.lit("acb"), "s").alias("b"), T.holds_in_order(F.lit(""), "s").alias("c")).first()
    assert (r.a, r.b, r.c) == (True, False, True)
    r = one(spark, '```json\n{"a": 1}\n```').select(T.json_object("s", "a int").alias("j"), T.json_object(F.lit("none"), "a int").alias("k")).first()
    assert r.j.a == 1 and r.k is None
    assert one(spark, "会议_周会_2025年第33周-议题4-绩效").select(T.title_topic("s").alias("t"), T.title_period("s").alias("p"), T.short_name(F.lit("a_b/c")).alias("n")).first() == ("周会/绩效", "2025W33", "c")
    r = one(spark, "d:3").select(T.neighbours("s").alias("a"), T.neighbours(F.lit("d:1")).alias("b"), T.neighbours(F.lit("d:x")).alias("c")).first()
    assert (r.a, r.b, r.c) == (["d:2", "d:4"], ["d:2"], [])
    r = one(spark, None).select(T.tokens(F.lit("中文字 Ab1"), True).alias("t"), T.overlap_share(F.array(*map(F.lit, (0.0, 0.0, 2.0, 2.0))), F.array(*map(F.lit, (1.0, 0.0, 3.0, 2.0)))).alias("o")).first()
    assert r.t == ["中文", "文字", "ab1"] and r.o == 0.5
    import uuid

    assert one(spark, "x:1").select(T.name_uuid("s").alias("u")).first().u == str(uuid.uuid5(uuid.NAMESPACE_URL, "x:1"))


def test_fixed_chunks(spark):
    for n, want in ((1000, [0, 448, 896]), (960, [0, 448]), (0, []), (1, [0])):
        assert [r.start for r in chunk.chunk_fixed(spark.createDataFrame([(1, "x" * n)], "doc_id int, text string")).orderBy("chunk_no").collect()] == want
    blank = "x" * 448 + " " * 600 + "y" * 10
    assert [r.chunk_no for r in chunk.chunk_fixed(spark.createDataFrame([(1, blank)], "doc_id int, text string")).collect()] == [1, 2]
    with pytest.raises(ValueError, match="unknown"):
        chunk.chunk_by("none", spark.range(1))


def test_sentence_windows():
    s = ["a" * 249 + "。", "b" * 249 + "。", "c" * 249 + "。", "d" * 249 + "。"]
    assert chunk.sentence_windows("".join(s)) == [s[0] + s[1], s[1] + s[2], s[2] + s[3]]
    assert [len(x) for x in chunk.sentence_windows("x" * 1500)] == [600, 600, 300]
    assert [len(x) for x in chunk.sentence_windows("x" * 1500, lossless=False)] == [600]
    assert chunk.sentence_windows(" \n ") == []


def test_structural_chunks():
    h = lambda t: {"type": "heading", "text": t, "heading_level": 2}
    p = lambda n: {"type": "paragraph", "text": "x" * n, "page": 3}
    assert [(c["section_path"], c["page"]) for c in chunk.structural([h("A"), p(300), h("B"), p(100)])] == [(["A"], 3), (["A", "B"], 3)]
    assert [c["section_path"] for c in chunk.structural([h("A"), {"type": "table", "text": "|a|"}])] == [["A"]]
    assert [(c["block_type"], c["page"], c["text"]) for c in chunk.structural([h("A"), h("B")])] == [("heading", None, "A\nB")]
    assert chunk.structural([]) == []


def test_lossless_chunks_hold_all_text(spark, sf):
    for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect():
        windows = chunk.sentence_windows(r.text, ends=".!?;\n")
        pieces = [s[i : i + chunk.MOST] for s in chunk.cut_sentences(r.text, ".!?;\n") for i in range(0, len(s), chunk.MOST)]
        assert all(any(p in w for w in windows) for p in pieces) and all(len(w) <= chunk.MOST for w in windows)


@pytest.mark.parametrize(("limit", "hits", "fallback"), [(8, 2, True), (2, 2, False), (8, 3, False), (8, 0, True)])
def test_filter_fallback(spark, limit, hits, fallback):
    queries = spark.createDataFrame([("q",)], "query_id string")
    narrow, wide = results(spark, [f"n{i}" for i in range(hits)]) if hits else results(spark, ["x"]).where("false"), results(spark, [f"w{i}" for i in range(5)])
    got = retrieve.with_fallback(narrow, wide, queries, limit).collect()
    assert len(got) == (5 if fallback else hits) and all(r.filter_fallback == fallback and r.n_before_fallback == hits for r in got)


def test_diverse_documents(spark):
    assert [r.doc_id for r in retrieve.diverse(results(spark, ["d1", "d1", "d2", None, None, "d3"]), 3).orderBy("rank").collect()] == ["d1", "d2", None]


def test_filters(spark):
    assert retrieve.payload_filter({}) is None
    with pytest.raises(ValueError, match="no filter"):
        retrieve.payload_filter({"x; drop": 1})
    r = spark.range(1).select(retrieve.year_range(F.lit(2024), F.lit(True)).alias("a"), retrieve.year_range(F.lit(1234), F.lit(True)).alias("b")).first()
    assert (r.a.gte, r.a["lt"], r.b) == ("2024-01-01T00:00:00", "2025-01-01T00:00:00", None)


def test_dimension_check(spark):
    with pytest.raises(Exception, match="expected 3 dimensions"):
        retrieve.checked_dimension(spark.createDataFrame([([1.0],)], "embedding array<float>"), 3).collect()


def test_answers(spark):
    rows = [("[1][3]", 2, False), ("plain", 2, False), ("", 2, True), ("无法回答", 2, True)]
    got = [(r.citation_valid, r.citation_present, r.refusal_ok) for r in metrics.answer_checks(spark.createDataFrame(rows, "answer string, n_contexts int, refusable boolean")).collect()]
    assert got == [(False, True, None), (None, False, None), (None, None, None), (None, False, True)]


def test_key_points(spark):
    rows = [(k, i < hits) for k, hits in (("a", 7), ("b", 6), ("c", 0)) for i in range(8)]
    assert {r.item: r.grade for r in metrics.keypoint_grades(spark.createDataFrame(rows, "item string, hit boolean"), ["item"]).collect()} == {"a": "full", "b": "half", "c": "zero"}


def test_audit(spark):
    def run(n, missing, others):
        rows = [("t", None if i < missing else 1) for i in range(n)] + [("u", 1)] * others
        return any(r.rejected for r in metrics.missing_audit(spark.createDataFrame(rows, "type string, v int"), "type", "v").collect())

    assert run(5, 2, 45) and not run(4, 4, 46)


def test_sign_test(spark):
    for wins, losses, want in ((10, 2, 0.0386), (0, 0, 1.0), (0, 7, 2 / 2**7), (6, 0, 0.03125), (5, 5, 1.0)):
        p = spark.range(1).select(stats.sign_p(F.lit(wins), F.lit(losses)).alias("p")).first().p
        assert p == pytest.approx(want, abs=5e-5) and p == pytest.approx(stats.exact_sign_p(wins, losses))


@pytest.mark.parametrize(("p", "want"), [([0.01, 0.04, 0.03], [0.03, 0.06, 0.06]), ([0.9, 0.8], [1.0, 1.0]), ([0.04], [0.04]), ([], [])])
def test_holm(spark, p, want):
    rows = spark.createDataFrame(list(enumerate(p)), "test int, p double")
    assert [r.p_holm for r in stats.holm(rows).orderBy("test").collect()] == pytest.approx(want)


def test_kappa(spark):
    def kappa(tp, fp, fn, tn):
        rows = [(True, True)] * tp + [(True, False)] * fp + [(False, True)] * fn + [(False, False)] * tn + [(None, True)]
        return stats.kappa(spark.createDataFrame(rows, "a boolean, b boolean"), F.col("a"), F.col("b")).first()

    assert kappa(4, 1, 1, 4).kappa == 0.6 and kappa(4, 1, 1, 4).left_out == 1 and kappa(5, 0, 0, 0).kappa is None


def test_pairing(spark):
    base = spark.createDataFrame([(i, 1.0) for i in range(10)] + [(10, None)], "item_id int, score double")
    other = spark.createDataFrame([(i, 0.0 if i < 7 else 1.0) for i in range(10)] + [(11, 1.0)], "item_id int, score double")
    r = stats.difference(stats.paired(base, other)).first()
    assert (r.mean_diff, r.wins, r.losses, r.ties) == (-0.7, 0, 7, 3)
    with pytest.raises(ValueError, match="partial"):
        stats.complete(base, 20)
    assert stats.metric_name("hit_within_budget") == "hit_at_list"
    with pytest.raises(ValueError, match="unknown metric"):
        stats.metric_name("x")


def test_noise(spark):
    runs = spark.createDataFrame([("a", 1, "q1", 1.0), ("a", 1, "q2", 1.0), ("a", 2, "q1", 0.5), ("a", 2, "q2", 1.0), ("b", 1, "q1", 1.0)], "arm string, run_id int, item_id string, score double")
    items, spread = stats.pooled(runs)
    assert items.where("arm = 'a' and item_id = 'q1'").first().score == 0.75
    assert {r.arm: r.noise_range for r in spread.collect()} == {"a": 0.25, "b": None}


def test_bootstrap(spark):
    values = [0.1, -0.2, 0.3, 0.0, 0.5]
    pairs = spark.createDataFrame([("t", i, v) for i, v in enumerate(values)], "test string, item_id int, diff double")
    rng = random.Random(42)
    means = sorted(sum(rng.choices(values, k=5)) / 5 for _ in range(5000))
    for parts in (1, 3):
        r = stats.bootstrap(pairs.repartition(parts), "test").first()
        assert (r.low, r.high) == (means[125], means[4874])


def test_robustness(spark):
    def label(said, answers, zh=False):
        return one(spark, said).select(robustness.labels(F.col("s"), F.lit(answers) if not isinstance(answers, list) else F.array(*(F.array(*map(F.lit, a)) for a in answers)), F.lit(zh)).alias("l")).first().l

    assert label("has A and c", [["a"], ["b", "c"]]) == [1, 1] and label("x", [["a"]]) == [0]
    assert label("信 息不足 a", [["a"]], True) == [-1] and label("信 息不足 a", [["a"]]) == [1]
    rows = spark.createDataFrame([([-1], 1.0), ([1], 1.0), ([-1], 0.0), ([1, 0], 0.0)], "label array<int>, noise double")
    assert [r.c for r in rows.select(robustness.correct(F.col("label"), F.col("noise")).alias("c")).collect()] == [True, True, False, False]
    same = spark.createDataFrame([("zh", "0", [1], 0.0, "it is 170")], "dataset string, id string, label array<int>, noise_rate double, prediction string")
    records = spark.createDataFrame([("zh", "0", "170"), ("zh_fact", "0", "it")], "dataset string, id string, fake_answer string")
    assert robustness.also_false(same, records).count() == 1


def test_reconciling(spark):
    stored = spark.createDataFrame([("d1", 3), ("d2", 1), ("ghost", 4)], "doc_id string, chunks int")
    orphans, missing, counts = provenance.reconcile(stored, spark.createDataFrame([("d1",), ("d2",), ("d3",)], "doc_id string"))
    r = counts.first()
    assert [x.doc_id for x in orphans.collect()] == ["ghost"] and [x.doc_id for x in missing.collect()] == ["d3"] and (r.orphan_chunks, r.stored_chunks, r.kept) == (4, 8, 3)
    for o, k, yes, bad, want in ((0, 3, True, 0, "nothing"), (2, 3, False, 0, "report"), (2, 3, True, 1, "refuse: failures"), (5, 3, True, 0, "refuse: too many"), (2, 3, True, 0, "delete")):
        assert provenance.prune_decision(spark.createDataFrame([(o, k)], "orphans int, kept int"), F.lit(yes), F.lit(bad)).first().decision == want


def test_freezes_and_caches(spark):
    runs = spark.createDataFrame([("r1", "a"), ("r2", "b")], "run string, fp string")
    freezes = spark.createDataFrame([("a",)], "fp string")
    assert {r.run: r.warns for r in provenance.frozen(freezes, runs, ["fp"]).collect()} == {"r1": False, "r2": True}
    assert not any(r.warns for r in provenance.frozen(freezes.where("false"), runs, ["fp"]).collect())
    cache = spark.createDataFrame([("k", "old", 1), ("k", "new", 2)], "key string, v string, created_at int")
    got = {r.key: (r.v, r.cached) for r in provenance.cached_or(spark.createDataFrame([("k",), ("x",)], "key string"), cache, "key", "v", F.lit("made")).collect()}
    assert got == {"k": ("new", True), "x": ("made", False)}
    a, b = (spark.range(1).select(provenance.fingerprint(x=F.lit(v).cast("string"), y=F.lit(1)).alias("f")).first().f for v in (None, ""))
    assert a != b and len(a) == 16
    r = spark.range(1).select(provenance.retryable(F.lit(429), F.lit(None).cast("boolean")).alias("a"), provenance.retryable(F.lit(404), F.lit(False)).alias("b")).first()
    assert r.a and not r.b


def test_samples(spark):
    assert [r.id for r in mining.uniform_sample(spark.range(10).repartition(3), 4, "id").orderBy("id").collect()] == [0, 2, 5, 7]
    assert mining.uniform_sample(spark.range(3), 4, "id").count() == 3
    rows = spark.range(10).withColumn("g", F.lit("a"))
    assert [r.id for r in mining.even_picks(rows, ["g"], "id", 4).orderBy("id").collect()] == [0, 2, 5, 7]


def test_windows_and_violations(spark):
    chunks = spark.createDataFrame([("d", 1, "project alpha is discussed"), ("d", 2, "it costs 15% at last, agreed"), ("d", 3, "nothing")], "doc_id string, chunk_no int, text string")
    pairs = mining.window_pairs(mining.adjacent(chunks), F.array(F.lit("alpha")), "[0-9]+%", "agreed")
    r = pairs.first()
    assert pairs.count() == 1 and (r.subject, r.value, r.cue, r.a_no) == ("alpha", "15%", True, 1)
    assert mining.window_violations(pairs).count() == 0
    broken = pairs.withColumn("a_text", F.lit("costs 15%")).withColumn("b_no", F.lit(9))
    assert {v.violation for v in mining.window_violations(broken).collect()} == {"not adjacent", "subject not in a", "value in a"}


def test_unique_phrases(spark):
    docs = spark.createDataFrame([(1, "common words here, only in the first one"), (2, "common words here; only in the second"), (3, "prefix common words here")], "doc_id int, text string")
    assert {r.doc_id: r.phrase for r in mining.unique_phrases(docs).collect()} == {1: "onlyinthefirstone", 2: "onlyinthesecond", 3: "prefixcommonwordshere"}


def test_unique_phrases_are_sought_among_all(spark):
    """A document whose only phrase of its own comes after thirty longer ones that another has as parts of longer phrases; rows of one id and
    of none; copies; marks inside a phrase."""
    shared = [f"shared phrase of both {'x' * (40 - i)}{i:02d}" for i in range(30)]
    rows = [(1, ", ".join([*shared, "mine alone"])), (2, "; ".join(f"more {s} more" for s in shared)), (3, "a copied text"), (4, "a copied text"), (5, ""), (6, None)]
    rows += [(7, "short one of seven"), (7, "the longer one of seven"), (None, ", ".join([*shared[:3], "nobody's"])), (8, "some_words *marked*"), (9, "somewordsmarked, said again here")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: r.phrase for r in mining.unique_phrases(docs, 8, 80).collect()}
    assert len(got[2]) > 50 and {k: v for k, v in got.items() if k != 2} == {1: "minealone", 3: "acopiedtext", 4: "acopiedtext", 7: "thelongeroneofseven", None: "nobody's", 9: "saidagainhere"}


def test_greedy_terms(spark):
    rows = spark.createDataFrame([(f"d{i}", f"l{i % 3}", f"c{i}", f"f{i % 2}", f"k{i % 2}") for i in range(40)], "doc_id string, label string, core string, family string, cat string")
    got = mining.taken_in_turn(rows, 12).collect()
    assert len({r.doc_id for r in got}) == len(got) and max(sum(r.label == x.label for r in got) for x in got) <= 2 and max(sum(r.cat == x.cat for r in got) for x in got) <= 3


def test_limiter():
    limiter = live.Limiter(2)
    assert [limiter.admits(t) for t in (0, 1, 2, 60.5, 61.5)] == [True, True, False, True, True]


def test_limiter_on_the_log(spark, sf):
    log = spark.read.parquet(f"{sf}/events.parquet")
    want = {}
    for key in ("click", "view"):
        own = live.Limiter(1, 3600.0)
        for r in log.where(F.col("event_type") == key).orderBy("ts", "event_id").collect():
            want[r.event_id] = own.admits((r.ts - __import__("datetime").datetime(1970, 1, 1)).total_seconds())
    got = {r.event_id: r.admitted for r in live.admissions(log.where("event_type in ('click', 'view')"), "event_type", "ts", "event_id", 1, 3600.0).collect()}
    assert got == want and len(set(got.values())) == 2


def test_streams_equal_batches(spark, sf, tmp_path):
    log = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "event_type", "ts", "value")
    log.repartition(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    for name, df in (("admitted", live.admissions_stream(stream, "event_type", "ts", "event_id", 1, 3600.0)), ("windows", live.rolling_quantiles(stream, "ts", "value", "event_type", "1 day"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    batch = live.admissions(log, "event_type", "ts", "event_id", 1, 3600.0)
    assert sorted(map(tuple, spark.table("admitted").select("no", "admitted").collect())) == sorted(map(tuple, batch.select("event_id", "admitted").collect()))
    exact = {(r.window_start, r.event_type): r.n for r in live.rolling_quantiles(log, "ts", "value", "event_type", "1 day").collect()}
    seen = {(r.window_start, r.event_type): r.n for r in spark.table("windows").collect()}
    assert seen and all(exact[k] == n for k, n in seen.items())


def test_sources(spark, tmp_path):
    (tmp_path / "raw" / "sub").mkdir(parents=True)
    for name, text in (("b.pdf", "same"), ("sub/a.PDF", "same"), ("c.txt", "x"), ("d.docx", "other")):
        (tmp_path / "raw" / name).write_text(text)
    files = tables.scan_files(spark, str(tmp_path / "raw"))
    got = {r.path.rsplit("/", 1)[-1]: r.is_duplicate for r in tables.first_of_each(files, "content", "path").collect()}
    assert got == {"b.pdf": False, "a.PDF": True, "d.docx": False}
    (tmp_path / "parsed").mkdir()
    (tmp_path / "parsed" / "1.json").write_text('{"meta": {"doc_id": "a"}, "blocks": [{"type": "paragraph", "text": "t"}]}')
    (tmp_path / "parsed" / "2.json").write_text('{"meta": {"doc_id": "b"}, "blocks": []}')
    (tmp_path / "parsed" / "3.json").write_text("{broken")
    (tmp_path / "parsed" / "profile.json").write_text("{}")
    good, counts = tables.read_parsed(spark, str(tmp_path / "parsed"))
    assert sorted((r.meta.doc_id, r.text) for r in good.collect()) == [("a", "t"), ("b", "")] and tuple(counts.first()) == (3, 1, 2)
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r.a for r in tables.read_lines(spark, str(tmp_path / "l.jsonl"), "a int").collect()] == [1, 2]
    tables.append_results(spark.range(2), str(tmp_path / "out"), "r1")
    tables.append_results(spark.range(3), str(tmp_path / "out"), "r2")
    assert spark.read.parquet(str(tmp_path / "out")).where("run_id = 'r2'").count() == 3
    incoming = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "k int, v string, at int")
    assert [tuple(r) for r in tables.upserted(spark.createDataFrame([(1, "o", 0), (2, "p", 0)], "k int, v string, at int"), incoming, "k", "at").orderBy("k").collect()] == [(1, "y", 2), (2, "p", 0)]
    m = tables.manifest(spark, str(tmp_path / "l.jsonl")).first()
    assert (m.file, m.bytes, m.lines) == ("l.jsonl", 19, 3)
    passages = spark.createDataFrame([("p",), ("p",), (None,)], "t string")
    assert tables.documents_of_passages(passages, "t").count() == 1


def test_containment_finds_all(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rng = random.Random(1)
    asked = []
    for i in range(60):
        t = texts[rng.choice(list(texts))]
        a = rng.randrange(len(t))
        asked.append((i, t[a : a + rng.randrange(1, 200)]))
    got = {(r.item_id, r.doc_id) for r in retrieve.containing(docs, spark.createDataFrame(asked, "item_id int, phrase string")).collect()}
    assert got == {(i, d) for i, p in asked for d, t in texts.items() if p in t}


def test_order_of_rows_does_not_matter(spark, sf):
    docs, asked = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr("item_id query_id", "text query")
    assert sorted(map(tuple, retrieve.bm25_topk(docs, asked, 5).collect())) == sorted(map(tuple, retrieve.bm25_topk(docs.repartition(7), asked.repartition(3), 5).collect()))
    assert math.isclose(retrieve.RRF_K, 60)


def test_layout(spark):
    rows = [(1, i, t, y, y + 10.0) for i, (t, y) in enumerate([("ab", 0.0), ("c", 12.0), (" ", 24.0), ("long line", 36.0), ("d", 48.0), ("e", 90.0), ("f", 102.0)])]
    r = layout.merged_lines(spark.createDataFrame(rows, "b int, no int, text string, y0 double, y1 double"), ["b"]).first()
    assert r.text == "abc\nlong line\nd\nef" and r.n_lines == 4
    blocks = [{"id": "a", "code": 3, "text": "H"}, {"id": "b", "code": 2, "text": " p "}, {"id": "c", "code": 99, "text": "x"}]
    assert layout.flattened(blocks) == [("heading", "H", 1), ("paragraph", "p", None)]
    loop = [{"id": "r", "code": 1, "children": ["x"]}, {"id": "x", "code": 24, "children": ["x", "y"]}, {"id": "y", "code": 12, "text": "i"}]
    assert layout.flattened(loop) == [("list_item", "i", None)] and layout.flattened([]) == []
    with pytest.raises(ValueError, match="arm"):
        layout.with_prefix(spark.range(1), F.lit("x"), "none")


def test_evidence_stops(spark):
    rows = [
        ("a", 1, False, True, 10, "n", 1), ("b", 1, True, True, 10, "n", 1), ("c", 1, False, False, 99, "n", 1), ("d", 1, False, False, 1, "n", 1), ("d", 2, False, False, 1, "n", 1), ("d", 3, False, False, 1, "n", 1),
        ("e", 1, False, False, 1, " ", 1), ("f", 1, False, False, 1, "n", 0), ("g", 1, False, False, 1, "n", 2),
    ]
    got = evidence.stops(spark.createDataFrame(rows, "query_id string, round int, degraded boolean, sufficient boolean, prompt_tokens int, next_query string, fresh int"), 3, 50)
    assert {r.query_id: r.stop_reason for r in got.collect()} == {"a": "sufficient", "b": "judge_degraded", "c": "token_budget", "d": "steps_exhausted", "e": "no_next_query", "f": "no_new_evidence", "g": "steps_exhausted"}


def test_sign_test_of_many_items(spark):
    for wins, losses in [(511, 512), (1000, 1000), (950, 1050), (0, 2000), (10_000, 10_000), (9_850, 10_150), (10_300, 9_700)]:
        n, term, tail = wins + losses, 1, 1
        for i in range(1, min(wins, losses) + 1):
            term = term * (n - i + 1) // i
            tail += term
        p = spark.createDataFrame([(wins, losses)], "w long, l long").select(stats.sign_p(F.col("w"), F.col("l")).alias("p")).first().p
        assert p == pytest.approx(min(1.0, 2 * tail / 2**n), rel=1e-9, abs=1e-300)


def test_assembled_documents(spark):
    """Against lists drawn here by the same generator, record by record."""
    pos, neg, wrong = [f"p{i}" for i in range(9)], [f"n{i}" for i in range(9)], [f"w{i}" for i in range(9)]
    rows = [("a", "zh", 0.4, pos, neg, wrong, None, 0.0), ("b", "zh", 1.0, pos, neg, wrong, None, 0.0), ("c", "zh_refine", 0.2, pos[:1], neg, wrong, None, 0.0), ("d", "zh", 0.8, pos, neg[:2], None, None, 0.0), ("e", "zh_fact", 0.0, pos[:3], neg, wrong[:3], None, 0.0), ("f", "zh_fact", 0.2, pos, neg, wrong, None, 0.4), ("g", "zh_int", 0.2, None, neg, None, [pos[:3], [], pos[3:5]], 0.0), ("h", "zh_int", 0.0, None, [], None, [], 0.0)]
    df = spark.createDataFrame(rows, "id string, dataset string, noise_rate double, positive array<string>, negative array<string>, wrong array<string>, groups array<array<string>>, correct_rate double")
    got = {r.id: r.docs for r in robustness.assemble(df.repartition(3)).collect()}

    def mixed(docs, rng=None):
        rng, docs = rng or random.Random(2333), [*docs]
        rng.shuffle(docs)
        return docs

    assert got["a"] == mixed(pos[:3] + neg[:2]) and got["b"] == mixed(neg[:5]) and got["c"] == mixed(pos[:1] + neg[:4]) and got["d"] == mixed(pos[:3] + neg[:2])
    rng = random.Random(2333)
    assert got["e"] == mixed([wrong[i] for i in rng.sample(range(3), 3)], rng)
    rng = random.Random(2333)
    bad = rng.sample(range(9), 2)
    good = rng.sample([i for i in range(9) if i not in bad], 2)
    assert got["f"] == mixed([wrong[i] for i in bad] + [pos[i] for i in good] + neg[:1], rng)
    rng = random.Random(2333)
    one, two = mixed(pos[:3], rng), mixed(pos[3:5], rng)
    assert got["g"] == mixed([one[0], two[0], one[1], two[1], neg[0]], rng) and got["h"] == []


def test_structural_chunks_by_marks():
    """Marks and paths against a walk over the blocks that keeps nothing but the open chunk."""
    rng = random.Random(5)
    for _ in range(300):
        blocks = [{"type": rng.choice(["heading", "table", "paragraph", "paragraph", "list_item"]), "text": rng.choice(["x", " ", "y" * 290, "z" * 320, "w" * 601, "a。" * 30]), "heading_level": rng.choice([None, 1, 2, 3]), "page": rng.choice([None, 1, 2])} for _ in range(rng.randrange(12))]
        # a heading without a level is text, its own type aside
        plain = [b | {"type": "paragraph"} if b["type"] == "heading" and b["heading_level"] is None else b for b in blocks]
        got, real = chunk.structural(plain), [b for b in plain if b["text"].strip()]
        bare = lambda chunks: [{k: v for k, v in c.items() if k != "block_type"} for c in chunks]
        assert bare(chunk.structural(blocks)) == bare(got)
        # all text is there, in order, but for what windows repeat
        flat = "".join(c["text"].replace("\n", "") for c in got if c["block_type"] != "heading")
        for b in real:
            assert b["type"] == "heading" or b["text"][: chunk.MOST] in flat
        tables = [c for c in got if c["block_type"] == "table"]
        assert [c["text"] for c in tables] == [b["text"] for b in real if b["type"] == "table"]
        trailing = 0
        while trailing < len(real) and real[-1 - trailing]["type"] == "heading":
            trailing += 1
        assert (got[-1]["block_type"] == "heading") == bool(trailing) if got else not real
        assert all(len(c["text"]) <= chunk.MOST for c in got if c["block_type"] not in ("heading", "table"))
    h = lambda t, n: {"type": "heading", "text": t, "heading_level": n}
    p = lambda n: {"type": "paragraph", "text": "x" * n, "page": None}
    # a heading splits text of 300 and not of 299; the path is that above the last block; levels may be skipped
    assert [(c["section_path"], len(c["text"])) for c in chunk.structural([h("A", 1), p(299), h("B", 3), p(5)])] == [(["A", "B"], 305)]
    assert [(c["section_path"], len(c["text"])) for c in chunk.structural([h("A", 1), p(300), h("B", 3), p(5), h("C", 1), h("D", 1)])] == [(["A"], 300), (["A", "B"], 5), (["A", "B"], 3)]
    assert [c["text"] for c in chunk.structural([p(600), p(7)])] == ["x" * 600, "x" * 7]
    # without a level: in the text of a chunk, in no path, and no chunk of its own at the end
    assert [(c["text"], c["section_path"], c["block_type"]) for c in chunk.structural([h("A", 1), h("B", None), p(3), h("C", 0)])] == [("B\nxxx\nC", ["A"], "heading")]
    assert [(c["text"], c["section_path"]) for c in chunk.structural([h("A", None)])] == [("A", [])]


def test_term_values(spark):
    values = ["85元/年", "67.5 元 / 月", "预算表(终稿).xlsx", "@黄梓姗", "91350206MA31EQ756Y", "2025-12-29", "13800001111", "《创始人探索条例》", "2核CPU，1G内存", "2025年第3周", "飞书导出平台", "需要负责人清单", "应用前景广阔"]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", mining.term_of(F.col("v")).alias("f"))
    assert [r.f for r in got.orderBy("i").collect()] == ["金额", "金额", "文件名", "人名", "编号", None, "编号", "名称", None, "周次", "制度名", None, None]


def test_greedy_terms_lose_nothing(spark):
    """The cut before the fold changes no choice: against a plain fold over all candidates."""
    rng = random.Random(3)
    rows = [(f"d{rng.randrange(60)}", f"l{int(rng.paretovariate(0.6)) % 40}", f"c{i}", f"f{rng.randrange(4)}") for i in range(4000)]
    rows = [(*r, f"k{int(r[0][1:]) % 9}") for r in rows]
    sha = lambda r: __import__("hashlib").sha256("|".join(r[:3]).encode()).hexdigest()
    for limit in (3, 12, 30):
        cap, docs, labels, cats, want = max(3, limit // 4), set(), {}, {}, []
        pools = {f: sorted((r for r in rows if r[3] == f), key=sha) for f in sorted({r[3] for r in rows})}
        while len(want) < limit and any(pools.values()):
            for pool in pools.values():
                while pool and (pool[0][0] in docs or labels.get(pool[0][1], 0) >= 2 or cats.get(pool[0][4], 0) >= cap):
                    del pool[0]
                if pool and len(want) < limit:
                    r = pool.pop(0)
                    want.append(r[2])
                    docs.add(r[0])
                    labels[r[1]] = labels.get(r[1], 0) + 1
                    cats[r[4]] = cats.get(r[4], 0) + 1
        df = spark.createDataFrame(rows, "doc_id string, label string, core string, family string, cat string")
        assert [r.core for r in mining.taken_in_turn(df, limit).orderBy("turn").collect()] == want


def test_decisions_in_order(spark):
    line = lambda x: f"关于{x}的动议，一致通过，自下月起生效"
    text = lambda *xs: "".join(f"决议区\n{line(x)}\n投票区\n" for x in xs)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([text("甲"), text("甲", "乙"), text("乙", "甲"), text("丙"), "决议区\n太短，通过"])], "doc_id int, text string")
    got = sorted((r.doc_id, r.decision) for r in mining.decisions(docs).collect())
    assert got == [(0, line("甲")), (1, line("乙")), (3, line("丙"))]
    assert len(mining.decisions(docs, top=2).collect()) == 2


def test_places(spark):
    rng = random.Random(7)
    rows = [(rng.choice([None, *range(20_000)]), i) for i in range(30_000)]
    df = spark.createDataFrame(rows, "v int, i int").repartition(5)
    got = places.placed(df, ["v", "i"], "place", "total").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.v, r.i) for r in sorted(got, key=lambda r: r.place)] == want and {r.total for r in got} == {30_000}
    assert places.placed(df.where("false"), ["v"], "place").count() == 0
    with pytest.raises(ValueError, match="rows"):
        places.zipped(spark.range(3), spark.range(4).withColumnRenamed("id", "k"), ["id"], ["k"])


def test_registry(spark, tmp_path):
    path = str(tmp_path / "reg")
    assert tables.load_registry(spark, path).count() == 0
    tables.save_registry(spark.createDataFrame([("a", "1")], "name string, fingerprint string"), path)
    assert [tuple(r) for r in tables.load_registry(spark, path).collect()] == [("a", "1")]
    (tmp_path / "bad.json").write_text("{no json")
    assert tables.load_registry(spark, str(tmp_path / "bad.json")).count() == 0


def test_dense_against_all(spark, sf):
    import numpy as np

    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in e.collect()}
    got = {(r.query_id, r["rank"]): r.vec_id for r in retrieve.dense_topk(e, e.where("vec_id % 50 = 0"), 4, piece=1).collect()}
    cos = lambda a, b: round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 6)
    for q in (i for i in rows if i % 50 == 0):
        want = sorted((-cos(rows[q], v), i) for i, v in rows.items() if i != q)[:4]
        assert [got[q, n + 1] for n in range(4)] == [i for _, i in want]
    odd = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0]), (2, None), (3, [1.0, 1.0])], "vec_id int, embedding array<float>")
    assert sorted((r.query_id, r.vec_id, r.score) for r in retrieve.dense_topk(odd, odd, 1).collect()) == [(0, 1, 0.0), (1, 3, 0.707107), (3, 1, 0.707107)]

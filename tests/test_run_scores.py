"""Scores by item from result files: values, what has none, and runs that are refused."""

import json

import pytest

from sparrowdoc.operators import stats

ITEMS = [
    {"id": "a", "type": "fact", "doc_coverage": 0.5, "doc_coverage_ceiling": 0.5, "first_hit_rank": 6, "ndcg_at_8": 0.3, "ap_at_5": 0.1, "answered_ok": True, "n_retrieved": 9, "keypoint_hit": 0.25, "n_key_points": 4},
    {"id": "b", "doc_coverage": 0.0, "doc_coverage_ceiling": 0.0, "first_hit_rank": None, "answered_ok": False},
    {"id": "c", "type": "none", "first_hit_rank": 1, "answered_ok": None},
]


def write(folder, name, **content):
    (folder / name).write_text(content.pop("raw", None) or json.dumps(content))


def scores(df):
    return {(r.run_id, r.item_id, r.metric): r.score for r in df.collect()}


def test_values(spark, tmp_path):
    write(tmp_path, "one.json", meta={"partial": False, "n_items": 3}, items=ITEMS, extra=[1])
    _, items, _ = stats.read_runs(spark, str(tmp_path))
    got = scores(stats.item_scores(items))
    a = {m: v for (_, i, m), v in got.items() if i == "a"}
    assert a == {"hit_at_5": 0.0, "hit_at_8": 1.0, "hit_at_list": 1.0, "mrr": 1 / 6, "ndcg_at_8": 0.3, "recall_at_list": 0.5, "recall_vs_ceiling": 1.0, "map_at_5": 0.1, "answered_ok": 1.0, "keypoint_recall": 0.25}
    # no ceiling, no ratio; without gold nothing of retrieval; what is not measured is not 0
    assert {m: v for (_, i, m), v in got.items() if i == "b"} == {"hit_at_5": 0.0, "hit_at_8": 0.0, "hit_at_list": 0.0, "mrr": 0.0, "recall_at_list": 0.0, "answered_ok": 0.0}
    assert not [k for k in got if k[1] == "c"]
    first = stats.load_scores(spark, str(tmp_path), "keypoint_hit_ratio").first()
    assert (first.metric, first.track, first.k, first.list_len, first.type) == ("keypoint_recall", "answer", 4, 9, "fact")
    with pytest.raises(ValueError, match="unknown metric"):
        stats.load_scores(spark, str(tmp_path), "x")


def test_judged(spark, tmp_path):
    rows = [{"id": "a", "faithfulness": 0.5, "n_contexts": 3}, {"id": "b", "faithfulness": None}]
    write(tmp_path, "one.json", summary={"per_item": rows})
    write(tmp_path, "two.json", summary={"hit": 1}, ragas={"per_item": rows[:1]}, items=ITEMS)
    got = stats.load_scores(spark, str(tmp_path), "faithfulness").collect()
    assert sorted((r.run_id, r.item_id, r.track, r.score, r.ctx_len) for r in got) == [("one.json", "a", "judged", 0.5, 3), ("two.json", "a", "judged", 0.5, 3)]


def test_refused(spark, tmp_path):
    write(tmp_path, "a.json", meta={"n_items": 3}, items=ITEMS)
    write(tmp_path, "b.json", meta={"partial": True}, items=ITEMS)
    write(tmp_path, "c.json", raw='{"items": [')
    write(tmp_path, "d.json", items=[])
    write(tmp_path, "e.json", meta={"n_items": 4}, items=ITEMS)
    write(tmp_path, "f.json", items=ITEMS + ITEMS[:1])
    runs, items, _ = stats.read_runs(spark, str(tmp_path))
    assert [tuple(r) for r in stats.refused_runs(runs, items).orderBy("run_id").collect()] == [("b.json", "partial", 3), ("c.json", "partial", 0), ("d.json", "no items", 0), ("e.json", "too few items", 3), ("f.json", "an item twice", 3)]
    with pytest.raises(ValueError, match="b.json: partial; c.json"):
        stats.load_scores(spark, str(tmp_path), "mrr")
    assert stats.load_scores(spark, str(tmp_path / "a.json"), "mrr").count() == 2

"""Readers: what becomes of each file and line."""

import json

import pytest

from sparrowdoc.operators import places
from sparrowdoc.sources import readers, tables


def made(root):
    long = "word " * 40
    files = {
        "a.json": json.dumps({"meta": {"doc_id": "a", "title": "A"}, "blocks": [{"type": "p", "text": long}, {"type": "image"}, {"type": "p", "text": "end"}]}),
        "b.json": json.dumps({"meta": {"doc_id": "b"}, "blocks": []}),
        "c.json": '{"meta": {"doc_id": "c"',
        "d.json": json.dumps({"meta": {"title": "no id"}, "blocks": [{"type": "p", "text": long}]}),
        "e.json": "[1, 2]",
        "f.json": " ",
        "g.json": json.dumps({"meta": {"doc_id": "g"}, "blocks": [{"type": "p", "text": "  short  "}]}),
        "profile.json": json.dumps({"meta": {"doc_id": "p"}, "blocks": [{"type": "p", "text": long}]}),
        "note.txt": "not one of them",
    }
    for name, text in files.items():
        (root / name).write_text(text)
    (root / "h.json").write_bytes(b'{"meta": {"doc_id": "\xff"}}')


def test_three_readers(spark, tmp_path):
    made(tmp_path)
    files = readers.files_below(spark, str(tmp_path), ("json",))
    got = {r: {x.file: (x.outcome, x.error) for x in readers.parsed_documents(files, r).collect()} for r in ("index", "items", "census")}
    assert got["index"] == {"a.json": ("read", None), "b.json": ("empty", "no blocks"), "c.json": ("failed", "no JSON object"), "d.json": ("failed", "no doc_id"), "e.json": ("failed", "no JSON object"), "f.json": ("failed", "no JSON object"), "g.json": ("read", None), "h.json": ("failed", "no JSON object"), "profile.json": ("skipped", "profile")}
    assert {k for k, v in got["items"].items() if v[0] == "read"} == {"a.json"} and got["items"]["g.json"] == ("skipped", "short") and got["items"]["d.json"] == ("failed", "no doc_id") and got["items"]["c.json"][0] == "skipped"
    assert {k for k, v in got["census"].items() if v[0] == "skipped"} == {"c.json", "f.json", "h.json"}
    assert tuple(readers.counts(readers.parsed_documents(files, "index")).first()) == (9, 2, 1, 1, 5)
    one = {r.file: r for r in readers.parsed_documents(files, "items").collect()}["a.json"]
    assert (one.title, one.doc_id, one.text) == ("A", "a", "word " * 40 + "\nend")
    assert tuple(readers.counts(readers.parsed_documents(files.where("false"))).first()) == (0, 0, 0, 0, 0)
    with pytest.raises(ValueError):
        readers.parsed_documents(files, "other")


def test_one_bad_file_fails_alone(spark, tmp_path):
    (tmp_path / "x/y").mkdir(parents=True)
    for name, content in (("1.pdf", b"one"), ("x/2.PDF", b"one"), ("x/y/3.docx", b"bad"), ("x/4.doc", b" "), ("5.exe", b"no"), ("6.pdf", b"six")):
        (tmp_path / name).write_bytes(content)

    def parse(content, suffix):
        if content == b"bad":
            raise RuntimeError("broken file")
        return f"{content.decode()}" if content.strip() else " "

    files = readers.files_below(spark, str(tmp_path), ("pdf", "docx", "doc"))
    found = readers.parsed_by(files, parse)
    got = {r.path.rsplit("/", 1)[1]: (r.outcome, r.error) for r in found.collect()}
    assert got == {"1.pdf": ("read", None), "2.PDF": ("skipped", "duplicate"), "3.docx": ("failed", "RuntimeError: broken file"), "4.doc": ("empty", None), "6.pdf": ("read", None)}
    assert tuple(readers.counts(found).first()) == (5, 2, 1, 1, 1)
    first = readers.parsed_by(readers.files_below(spark, str(tmp_path), ("pdf", "docx", "doc"), limit=2), parse)
    assert sorted(r.path.rsplit("/", 1)[1] for r in first.collect()) == ["1.pdf", "6.pdf"]


def test_lines(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"id": 1, "t": "a"}\n\n  \n{"id": 2, "t": \n[1]\n"x"\n{"t": "no id"}\n{"id": "word", "t": "b"}\n{"id": 3, "t": "c"}\n')
    lines = readers.json_lines(spark, str(tmp_path / "l.jsonl"), "id long, t string", needed=("id",))
    assert sorted(map(tuple, readers.records(lines).collect())) == [(1, "a"), (3, "c")]
    assert tuple(readers.counts(lines).first()) == (9, 2, 0, 2, 5)
    assert sorted((r.error, r.line) for r in lines.where("outcome = 'failed'").collect())[0] == ("no JSON object", '"x"')
    assert readers.json_lines(spark, str(tmp_path / "none"), "id long, t string").count() == 0


def test_names_of_outcomes(spark, monkeypatch):
    """Places within outcomes, by one range and by several; nulls and repeated names."""
    data = [("b", "x"), ("a", "z"), ("a", "y"), ("a", "y"), (None, "q"), ("a", None), ("", "w")]
    want = [(None, 1, 1, "q"), ("", 1, 1, "w"), ("a", 4, 1, None), ("a", 4, 2, "y"), ("a", 4, 3, "y"), ("a", 4, 4, "z"), ("b", 1, 1, "x")]
    rows = spark.createDataFrame(data, "outcome string, name string")
    got = lambda: sorted(map(tuple, tables.outcomes_with_names(rows, "outcome", "name").collect()), key=repr)
    assert got() == sorted(want, key=repr)
    monkeypatch.setattr(places, "RANGE_ROWS", 2)
    assert got() == sorted(want, key=repr)
    assert tables.outcomes_with_names(rows.where("false"), "outcome", "name").collect() == []

"""Structural chunks leave a worker as they are made."""

import pyarrow as pa

from sparrowdoc.operators import chunk


def test_a_large_batch_is_cut_in_parts(monkeypatch):
    """No batch that is passed on holds the chunks of more than PART documents, whatever Arrow hands over at once."""
    block = pa.struct([("type", pa.string()), ("text", pa.string()), ("heading_level", pa.int32()), ("page", pa.int32())])
    blocks = [[{"type": "paragraph", "text": f"text {i}", "heading_level": None, "page": None}] for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(1000)]), pa.array([*blocks[:-1], None], pa.list_(block))], names=["doc_id", "blocks"])

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return [*run([batch])]

    monkeypatch.setattr(chunk.F, "col", lambda name: type("C", (), {"cast": lambda self, kind: name})())
    made = chunk.chunk_structural(Docs())
    assert max(len(b) for b in made) <= 64 and sum(len(b) for b in made) == 999
    assert [x for b in made for x in b.column(3).to_pylist()] == [f"text {i}" for i in range(999)]

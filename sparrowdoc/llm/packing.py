"""Packing of tokenised documents into windows of a fixed size, online and in bounded space.

Each partition keeps a fixed number of open windows. A document goes whole to the fullest window that has room for it; a
document longer than a window gives full windows first. If none has room, the fullest window is emitted, and a large
gap in it is first filled with the head of the document. Windows that are still open when a partition ends are merged
with those of the partitions beside it, cut where a window is full, so that such a group leaves at most one window
with a gap.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowdoc.llm.common import Scratch, small_batches, tidy
from sparrowdoc.llm.tokens import MEMORY, Bare, encoder

WINDOW, OPEN, END = 4096, 64, 2
#: A gap of at least so many tokens is filled by cutting a document; a smaller one is padded.
GAP = 48
#: Partitions whose open windows are merged together: at most MERGED * OPEN windows meet in a task.
MERGED = 16
#: Texts that are cut into parts at once.
ROWS = 100

NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Windows:
    """The open windows of a partition. Pieces are (doc, start, ids as bytes, tokens of the document)."""

    def __init__(self, first_id: int, size: int = WINDOW, most: int = OPEN, gap: int = GAP):
        self.next, self.size, self.most, self.gap = first_id, size, most, gap
        self.open: list[list] = []  # [tokens, pieces]

    def emit(self, pieces: list):
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            yield doc, start, n, zlib.crc32(ids), total, self.next, at
            at += n
        self.next += 1

    def put(self, window: list, piece: tuple):
        window[0] += len(piece[2]) // 4
        window[1].append(piece)
        if window[0] == self.size:
            self.open.remove(window)
            yield from self.emit(window[1])

    def add(self, doc, ids: bytes):
        total, start, width = len(ids) // 4, 0, 4 * self.size
        while total - start >= self.size:
            yield from self.emit([(doc, start, ids[4 * start : 4 * start + width], total)])
            start += self.size
        rest = ids[4 * start :]
        while rest:
            n = len(rest) // 4
            fits = [w for w in self.open if w[0] + n <= self.size]
            if fits:
                yield from self.put(max(fits, key=lambda w: w[0]), (doc, start, rest, total))
                return
            if len(self.open) < self.most:
                self.open.append([n, [(doc, start, rest, total)]])
                return
            fullest = max(self.open, key=lambda w: w[0])
            room = self.size - fullest[0]
            if room >= self.gap:
                yield from self.put(fullest, (doc, start, rest[: 4 * room], total))
                start, rest = start + room, rest[4 * room :]
            else:
                self.open.remove(fullest)
                yield from self.emit(fullest[1])


def _table(rows: list, kind: pa.DataType, extra: list | None = None) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(7 + len(extra or []))]
    types = [kind, *[pa.int64()] * 6, *(t for _, t in extra or [])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*NAMES, *(n for n, _ in extra or [])])


def merge(pieces: list, first_id: int, size: int = WINDOW):
    """Pieces in order, cut where a window is full."""
    windows, held, used = Windows(first_id, size), [], 0
    for doc, start, ids, total in pieces:
        while ids:
            take = ids[: 4 * (size - used)]
            held.append((doc, start, take, total))
            n = len(take) // 4
            used, start, ids = used + n, start + n, ids[len(take) :]
            if used == size:
                yield from windows.emit(held)
                held, used = [], 0
    if held:
        yield from windows.emit(held)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, end: int | None = END, memory: int = MEMORY) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    docs' texts become the ids of the tokenizer file (of the tokenizers library) without special tokens, and `end` after
    each. A piece is `length` of its document's ids from `start`, at `offset` of the sequence. ids_crc32 is of the piece's
    ids as little-endian unsigned 32-bit numbers. Null and empty texts have the end alone; repeated rows are packed each
    time; a null id stays null; other columns are not read; an empty table gives no rows. `memory` bounds the parts of texts
    whose ids a worker remembers; it changes no result.

    Pieces are written to a table before the open windows are merged, so that nothing is tokenised twice.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    small_batches(spark)
    with open(tokenizer, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())  # of fixed size
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    last = b"" if end is None else np.array([end], "<u4").tobytes()
    extra = [("part", pa.int64()), ("ids", pa.binary())]

    @tidy
    def run(batches):
        part = TaskContext.get().partitionId()
        own, windows, id_type, out = encoder(sent.value, Bare, memory), Windows(part << 32, size), None, []
        for batch in batches:
            id_type = batch.column(0).type
            for at in range(0, len(batch), ROWS):
                some = batch.slice(at, ROWS)
                for doc, ids in zip(some.column(0).to_pylist(), own.batch(some.column(1).to_pylist()), strict=True):
                    out += [(*x, part, None) for x in windows.add(doc, ids + last)]
                if out:
                    yield _table(out, id_type, extra)
                    out = []
        own.forget()
        for order, (_, pieces) in enumerate(windows.open):
            out += [(doc, start, len(ids) // 4, zlib.crc32(ids), total, order, at, part, ids) for at, (doc, start, ids, total) in enumerate(pieces)]
        if out:
            yield _table(out, id_type, extra)

    fields = f"doc_id {kind}, {', '.join(f'{n} long' for n in NAMES[1:])}"
    placed = scratch.keep(rows.mapInArrow(run, f"{fields}, part long, ids binary"))
    group = F.expr(f"part div {MERGED}")

    def close(key, table):
        table = table.sort_by([("part", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        pieces = zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True)
        return pa.Table.from_batches([_table(list(merge(pieces, ((1 << 30) + key[0].as_py()) << 32, size)), table.schema.field("doc_id").type)])

    open_ = placed.where("ids is not null").withColumn("g", group).groupBy("g").applyInArrow(close, fields)
    return placed.where("ids is null").select(*NAMES).union(open_).withColumnRenamed("doc_id", id_col)

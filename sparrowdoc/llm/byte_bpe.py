"""Byte-level BPE encoding and decoding of a text column."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowdoc.llm.common import small_batches, tidy
from sparrowdoc.llm.tokens import Spaced, byte_bpe, byte_values, encoder, load


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows, rows.schema["doc"].dataType.simpleString()


def _sent(docs: DataFrame, ranks: str, pattern: str):
    """The vocabulary: of fixed size."""
    return docs.sparkSession.sparkContext.broadcast(byte_bpe(ranks, pattern))


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>, starts array<int>, ends array<int> for each row of docs.

    ids are those of the rank file, each match of the pattern encoded alone, strings of special tokens as ordinary text.
    starts and ends are offsets in code points; a token that holds a part of a character has the offsets of that
    character. Null and empty texts have no ids; other columns are not read; an empty table gives no rows.
    """
    rows, kind = _rows(docs, id_col, text_col)
    sent = _sent(docs, ranks, pattern)

    def run(batches):
        tokenizer = load(sent.value)
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                found = tokenizer.encode_batch(part.column(1).to_pylist(), add_special_tokens=False)
                spans = [e.offsets for e in found]
                columns = [[e.ids for e in found], [[a for a, _ in s] for s in spans], [[b for _, b in s] for s in spans]]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.list_(pa.int32())) for c in columns)], names=["doc", "ids", "starts", "ends"])

    return rows.mapInArrow(run, f"doc {kind}, ids array<int>, starts array<int>, ends array<int>").withColumnRenamed("doc", id_col)


def decode(encoded: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, bytes, text: the inverse of encode. Bytes that are no whole character (a cut inside one) show as U+FFFD in text.

    Null ids give null; ids outside the vocabulary raise an error.
    """
    rows = encoded.select(F.col(id_col).alias("doc"), F.col(ids_col).cast("array<int>").alias("ids"))
    sent = _sent(encoded, ranks, pattern)

    def run(batches):
        table = byte_values(load(sent.value))
        for batch in batches:
            out = [None if ids is None else b"".join(map(table.__getitem__, ids)) for ids in batch.column(1).to_pylist()]
            text = [None if x is None else x.decode("utf-8", "replace") for x in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(text, pa.string())], names=["doc", "bytes", "text"])

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, bytes binary, text string").withColumnRenamed("doc", id_col)


def round_trips(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256 (bytes decoded from the ids) for each row.

    Encodes and decodes in one pass, text by text; rows are as in encode().
    """
    rows, kind = _rows(docs, id_col, text_col)
    sent = _sent(docs, ranks, pattern)

    small_batches(docs.sparkSession)

    @tidy
    def run(batches):
        own = encoder(sent.value, Spaced)
        values = byte_values(own.tokenizer)
        table = [values[i] for i in range(len(values))]
        decimal = [str(i).encode() for i in range(len(table))]
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                out = []
                for raw in own.batch(part.column(1).to_pylist()):
                    ids = np.frombuffer(raw, "<u4").tolist()
                    shown = hashlib.sha256(b" ".join(map(decimal.__getitem__, ids))).hexdigest()
                    out.append((len(ids), shown, hashlib.sha256(b"".join(map(table.__getitem__, ids))).hexdigest()))
                n, shown, decoded = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(shown), pa.array(decoded)], names=["doc", "n_tokens", "ids_sha256", "decoded_sha256"])
        own.forget()

    return rows.mapInArrow(run, f"doc {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("doc", id_col)

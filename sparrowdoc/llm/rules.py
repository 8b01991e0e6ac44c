"""Quality rules from line frequency across documents.

Each document's lines are trimmed, lower-cased (A-Z) and hashed; a line's frequency is the number of distinct documents
of its host that hold it. Lines above the host's limit are removed (cleaned() returns the texts without them), and documents that lose too much are
rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowdoc.llm.common import LOWER, SPACE, Rolling, Scratch, grams, row_counts, views, words

#: A line is common in a host if at least so many documents, and more than this share of the host's documents, hold it.
LEAST_DOCUMENTS, SHARE = 10, 0.02
#: A document is depleted if fewer words, or a smaller share of its words, stay.
LEAST_WORDS, LEAST_KEPT = 10, 0.5
WINDOW = 5

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _before(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each \\n-split line, empty ones too."""
    breaks = np.flatnonzero(data == 10)
    of = np.searchsorted(offsets, breaks, side="right") - 1
    rows = np.arange(len(offsets) - 1)
    row = np.concatenate([rows, of])
    start, end = np.concatenate([offsets[:-1], breaks + 1]), np.concatenate([offsets[1:], breaks])
    return start[np.lexsort((start, row))], end[np.lexsort((end, row))], np.sort(row)


def repeated(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: has its row an equal one before it; has its row an equal one at all."""
    order = np.lexsort((np.arange(len(keys)), keys, row))
    k, r = keys[order], row[order]
    same = np.zeros(len(k), bool)
    same[1:] = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    any_ = same.copy()
    any_[:-1] |= same[1:]
    before, at_all = np.zeros(len(k), bool), np.zeros(len(k), bool)
    before[order], at_all[order] = same, any_
    return before, at_all


def measures(data: np.ndarray, offsets: np.ndarray):
    """The five base counts of each row, and its distinct normalised lines with their words: (row, hash, words)."""
    rows = len(offsets) - 1
    start, end, row = words(data, offsets)
    points = _before((data & 0xC0) != 0x80)
    n_words = row_counts(row, rows)
    chars = np.bincount(row, points[end] - points[start], minlength=rows).astype(np.int64)
    symbols = np.diff(_before(SYMBOL[data])[offsets])
    roll = Rolling(data)
    ls, le, lrow = lines(data, offsets)
    inked = np.diff(_before(~SPACE[data])[np.stack([ls, le])], axis=0)[0] > 0
    ls, le, lrow = ls[inked], le[inked], lrow[inked]
    dup, _ = repeated(roll.slices(ls, le), lrow)
    dup_lines = row_counts(lrow[dup], rows)
    hashes, grow, at = grams(roll.slices(start, end), row, WINDOW)
    _, again = repeated(hashes, grow)
    edge = np.zeros(len(row) + WINDOW + 1, np.int64)
    np.add.at(edge, at[again], 1)
    np.add.at(edge, at[again] + WINDOW, -1)
    repeat = row_counts(row[np.cumsum(edge)[: len(row)] > 0], rows)
    # lines, trimmed and lower-cased
    first, last = np.searchsorted(start, ls), np.searchsorted(end, le, side="right") - 1
    own = Rolling(LOWER[data]).slices(start[first], end[last]) if len(ls) else np.empty(0, np.uint64)
    count = last - first + 1
    return (n_words, chars, symbols, dup_lines, repeat), (lrow, own.view(np.int64), count)


def _measure(batches):
    for batch in batches:
        for at, to, data, offsets in views(batch, 2):
            base, (row, line, count) = measures(data, offsets)
            cuts = np.searchsorted(row, np.arange(to - at + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), *(pa.array(x) for x in base), pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays([pa.array(line), pa.array(count)], ["h", "w"]))],
                names=["doc", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"],
            )


def _decided(docs: DataFrame, id_col: str, text_col: str, host_col: str, share: float, least_documents: int, row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One decision on docs: (row, doc, host, base counts, n_common_words, base_failed, kept), and the rows' lines that are
    common in their host (row, h, w). row is `row_col`, or else a number of its own."""
    scratch = Scratch(docs.sparkSession)
    first = F.struct(F.col(id_col).alias("id"), F.col(row_col).alias("row")) if row_col else F.col(id_col)
    rows = docs.select(first.alias("doc"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    table = scratch.keep(
        rows.mapInArrow(_measure, f"doc {kind}, host string, {STATS}, lines array<struct<h:long,w:long>>").withColumn("row", F.monotonically_increasing_id())
    )  # row ids hold from here on, as the table is written
    if row_col:
        table = table.withColumns({"doc": F.col("doc.id"), "row": F.col("doc.row")})
    own = table.select("row", "doc", "host", F.explode("lines").alias("l")).select("row", "doc", "host", F.col("l.h").alias("h"), F.col("l.w").alias("w"))
    counts = own.select("host", "h", "doc").distinct().groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= least_documents)
    hosts = table.select("host", "doc").distinct().groupBy("host").agg(F.count("*").alias("all"))
    common = counts.join(hosts, "host").where(F.col("n") > share * F.col("all")).select("host", "h")
    gone = own.join(common, ["host", "h"]).select("row", "h", "w")
    lost = gone.groupBy("row").agg(F.sum("w").alias("n_common_words"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_common_words")
    out = table.drop("lines").join(lost, "row", "left").withColumn("n_common_words", F.coalesce("n_common_words", F.lit(0).cast("long"))).withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (left >= LEAST_WORDS) & (left >= LEAST_KEPT * F.col("n_words"))
    return out.withColumn("kept", kept), gone


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", share: float = SHARE, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """One row for each row of docs: its id, the base counts, base_failed, n_common_words and kept.

    Words are runs of characters other than space and \\t..\\r. n_common_words: words in lines that are common in the
    document's host. kept: false if base_failed (n_words < 10, or over a fifth of the words in repeated five-word
    windows) or if the document is depleted without its common lines. Null and empty texts have no words and fail;
    null hosts are one host; rows with a null or repeated id are one document when lines are counted, and each has
    its own row in the result. Other columns are not read. An empty table gives no rows.
    """
    out, _ = _decided(docs, id_col, text_col, host_col, share, least_documents)
    return out.select(F.col("doc").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_common_words")


def _cut(at: int, names: list[str]):
    def run(batches):
        """(columns of docs, common hashes) -> the columns, the text at `at` without the lines of these hashes."""
        for batch in batches:
            for a, b, data, offsets in views(batch, at):
                start, end, row = words(data, offsets)
                ls, le, lrow = lines(data, offsets)
                first, last = np.searchsorted(start, ls), np.searchsorted(end, le, side="right") - 1
                inked = first <= last
                hashes = np.zeros(len(ls), np.int64)
                if inked.any():
                    hashes[inked] = Rolling(LOWER[data]).slices(start[first[inked]], end[last[inked]]).view(np.int64)
                cuts = np.searchsorted(lrow, np.arange(b - a + 1))
                texts = []
                for i, drop in enumerate(batch.column(len(names)).slice(a, b - a).to_pylist()):
                    own = slice(cuts[i], cuts[i + 1])
                    stays = ~(inked[own] & np.isin(hashes[own], np.array(drop or [], np.int64)))
                    texts.append(b"\n".join(data[x:y].tobytes() for x, y in zip(ls[own][stays], le[own][stays], strict=True)).decode())
                part = batch.slice(a, b - a)
                columns = [pa.array(texts, part.schema.field(j).type) if j == at else part.column(j) for j in range(len(names))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", share: float = SHARE, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """The rows of docs that line_rules() keeps, without the lines that are common in their host; all else as it is.

    A line goes with the break that parts it from the next one; of lines that stay, not a byte changes, and neither do other
    columns. Rows that fail, and rows depleted without their common lines, are left out.
    """
    scratch, names = Scratch(docs.sparkSession), [f"c{i}" for i in range(len(docs.columns))]
    own = {c: names[docs.columns.index(c)] for c in (id_col, text_col, host_col)}
    numbered = scratch.keep(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()))  # names may clash
    out, gone = _decided(numbered, own[id_col], own[text_col], own[host_col], share, least_documents, "row")
    drop = gone.groupBy("row").agg(F.collect_list("h").alias("drop"))
    kept = numbered.join(out.where("kept").select("row"), "row").join(drop, "row", "left").select(*names, "drop")
    return kept.mapInArrow(_cut(docs.columns.index(text_col), names), numbered.drop("row").schema).toDF(*docs.columns)

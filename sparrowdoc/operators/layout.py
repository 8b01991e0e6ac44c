"""From spans, tables and block trees to blocks: what comes between a parser's raw output and a document."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowdoc.functions.text import overlap_share, visible

#: A line of so few characters continues one above that is as short and close; a table owns a block that lies in it by half.
SHORT, GAP, TABLE_SHARE = 2, 1.6, 0.5
#: A heading is so much larger than the document's median, and so short.
LARGER, HEADING_CHARS = 1.15, 60


def merged_lines(lines: DataFrame, block: list[str], no: str = "no", text: str = "text", y0: str = "y0", y1: str = "y1") -> DataFrame:
    """Lines of a block -> its text: runs of short lines close below each other are one line."""
    rows = lines.withColumn("t", F.trim(visible(text, "layout"))).where("t <> ''")
    by = Window.partitionBy(*block).orderBy(no)
    short = F.length("t") <= SHORT
    rows = rows.withColumn("short", short).withColumn("above", F.lag(y1).over(by)).withColumn("was_short", F.lag(short).over(by))
    close = (F.col(y0) - F.col("above")) <= F.greatest(F.col(y1) - F.col(y0), F.lit(1.0)) * GAP
    joins = F.coalesce(F.col("short") & F.col("was_short") & close, F.lit(False))
    grouped = rows.withColumn("run", F.sum((~joins).cast("int")).over(by))
    in_order = lambda c, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(no, c))), lambda s: s[c]), sep)
    runs = grouped.groupBy(*block, "run").agg(F.min(no).alias(no), in_order("t", "").alias("line"))
    return runs.groupBy(*block).agg(F.count("*").alias("n_lines"), in_order("line", "\n").alias("text"))


def outside_tables(blocks: DataFrame, tables: DataFrame, page: list[str], bbox: str = "bbox") -> DataFrame:
    """Blocks that lie in no table of their page by more than half."""
    owned = blocks.join(tables.select(*page, F.col(bbox).alias("table_box")), page).where(overlap_share(F.col(bbox), F.col("table_box")) > TABLE_SHARE)
    keys = [*page, "block_no"]
    return blocks.join(owned.select(*keys).distinct(), keys, "left_anti")


def in_reading_order(blocks: DataFrame, doc: str = "doc_id", page: str = "page", y: str = "y", x: str = "x") -> DataFrame:
    return blocks.withColumn("block_no", F.row_number().over(Window.partitionBy(doc).orderBy(page, y, x)))


def with_headings(blocks: DataFrame, doc: str = "doc_id", size: str = "size", text: str = "text", kind: str = "type") -> DataFrame:
    """Paragraphs in large type, short and of one line, are headings of level 2; a document's median size is 10 without any."""
    median = blocks.groupBy(doc).agg(F.coalesce(F.median(size), F.lit(10.0)).alias("median_size"))
    out = blocks.join(median, doc)
    heading = (F.col(kind) == "paragraph") & (F.col(size) >= F.col("median_size") * LARGER) & (F.length(text) <= HEADING_CHARS) & ~F.contains(text, F.lit("\n"))
    return out.withColumn("heading_level", F.when(heading, 2)).withColumn(kind, F.when(heading, "heading").otherwise(F.col(kind))).drop("median_size")


#: Codes of a block tree: the root, headings 3 to 11, a table, and what else is text.
ROOT, TABLE, TEXT = 1, 31, {2: "paragraph", 12: "list_item", 13: "list_item", 15: "quote"}


def flattened(blocks: list[dict]) -> list[tuple[str, str, int | None]]:
    """A flat list of blocks (id, code, text, children, columns) -> (type, text, level) in order of the tree.

    A table's children are its cells, row by row. Without a root, blocks come in the order of the list.
    """
    of = {b["id"]: b for b in blocks}
    root = next((b for b in blocks if b["code"] == ROOT), None)
    out: list[tuple[str, str, int | None]] = []

    def emit(b: dict) -> None:
        text = (b.get("text") or "").strip()
        if b["code"] == TABLE:
            cells = [(of[c].get("text") or "").strip().replace("|", "\\|").replace("\n", " ") for c in b.get("children") or [] if c in of]
            width = max(1, b.get("columns") or 1)
            rows = ["| " + " | ".join(cells[i : i + width]) + " |" for i in range(0, len(cells), width)]
            if rows:
                out.append(("table", "\n".join([rows[0], "|" + "---|" * width, *rows[1:]]), None))
        elif 3 <= b["code"] <= 11 and text:
            out.append(("heading", text, b["code"] - 2))
        elif b["code"] in TEXT and text:
            out.append((TEXT[b["code"]], text, None))

    if root is None:
        for b in blocks:
            emit(b)
        return out
    stack, seen = list(reversed(root.get("children") or [])), set()
    while stack:
        b = of.get(stack.pop())
        if b is None or b["id"] in seen:
            continue
        seen.add(b["id"])
        emit(b)
        if b["code"] != TABLE:
            stack += reversed(b.get("children") or [])
    return out


def tree_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, blocks array<struct<id,code,text,children,columns>>) -> doc_id, block_no, type, text, heading_level."""

    def run(batches):
        for batch in batches:
            rows = [(doc, i, *b) for doc, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, b in enumerate(flattened(blocks or []), 1)]
            if rows:
                types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "block_no", "type", "text", "heading_level"])

    return docs.select(F.col("doc_id").cast("string"), "blocks").mapInArrow(run, "doc_id string, block_no int, type string, text string, heading_level int")


def with_prefix(chunks: DataFrame, prefix: Column, arm: str, text: str = "indexed") -> DataFrame:
    """The text of each index leg: a chunk's prefix stands before both, before that of terms alone, or nowhere."""
    if arm not in ("off", "both", "terms"):
        raise ValueError(f"unknown arm {arm!r}")
    own = F.when(prefix.isNotNull() & (F.trim(prefix) != ""), F.concat(prefix, F.lit("\n"), F.col(text))).otherwise(F.col(text))
    return chunks.withColumn("dense_text", own if arm == "both" else F.col(text)).withColumn("terms_text", F.col(text) if arm == "off" else own)

"""Documents to chunks: fixed windows as column expressions, structural chunks and sentence windows by marks of a document's blocks."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowdoc.functions.text import SENTENCE_ENDS

SIZE, OVERLAP = 512, 64
MOST, FLUSH_AT_HEADING, BACK = 600, 300, 0.12


def chunk_fixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, chunk_no (from 1), start, chunk for overlapping windows of `size` code points.

    Blank windows have no number. The last window is the first one, not blank, that reaches the end.
    """
    step = max(size - overlap, 1)
    text, n = F.col("t"), F.length("t")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).where(n > 0)
    made = F.transform(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda s: F.struct(s.alias("start"), F.substring(text, s + 1, F.lit(size)).alias("chunk")))
    kept = F.filter(made, lambda w: w["chunk"].rlike(r"(?U)\S"))
    inner, outer = F.filter("w", lambda w: w["start"] + size < F.col("n")), F.filter("w", lambda w: w["start"] + size >= F.col("n"))
    out = rows.select("doc_id", n.alias("n"), kept.alias("w")).select("doc_id", F.posexplode(F.concat(inner, F.slice(outer, 1, 1))).alias("i", "w"))
    return out.select("doc_id", (F.col("i") + 1).alias("chunk_no"), F.col("w.start").alias("start"), F.col("w.chunk").alias("chunk"))


def cut_sentences(text: str, ends: str = SENTENCE_ENDS) -> list[str]:
    return [p for p in re.split(f"(?<=[{re.escape(ends)}])", text) if p.strip()]


def sentence_windows(text: str, most: int = MOST, back: float = BACK, lossless: bool = True, ends: str = SENTENCE_ENDS) -> list[str]:
    """Windows of whole sentences of at most `most` characters; each begins with the end of the one before it.

    Where a window ends and the next begins are two searches in the sentences' running lengths. A longer sentence is a window
    of its own: cut into parts of that length, or, not lossless, its head alone.
    """
    pieces = cut_sentences(text, ends)
    until = [0, *accumulate(map(len, pieces))]
    out, first = [], 0
    while first < len(pieces):
        after = max(first + 1, bisect_right(until, until[first] + most) - 1)
        window = "".join(pieces[first:after])
        out.extend(window[i : i + most] for i in range(0, len(window) if lossless else 1, most))
        # the last sentence from which `back` of a window stands before the end, but always one further than now
        first = len(pieces) if after == len(pieces) else max(first + 1, bisect_right(until, until[after] - int(most * back)) - 1)
    return out


def chunk_marks(kinds: list[str], sizes: list[int], most: int = MOST, flush: int = FLUSH_AT_HEADING) -> list[int]:
    """The chunk of each block, from 1 in order; headings have 0. A table is alone; text shares a chunk until it has `most`
    characters, a table comes, or a heading does when it has `flush`."""
    marks, number, held = [], 0, 0
    for kind, size in zip(kinds, sizes, strict=True):
        if kind == "heading":
            held = 0 if held >= flush else held
            marks.append(0)
            continue
        number += kind == "table" or not held
        marks.append(number)
        held = 0 if kind == "table" or held + size >= most else held + size
    return marks


def section_paths(kinds: list[str], levels: list[int | None], texts: list[str]) -> list[list[str]]:
    """The headings above each block: each takes the place of its level, or the next free one, and what was below goes."""
    path: list[str] = []
    out = []
    for kind, level, text in zip(kinds, levels, texts, strict=True):
        if kind == "heading":
            path = [*path[: max(level or 1, 1) - 1], text.strip()]
        out.append(path)
    return out


def structural(blocks: list[dict], most: int = MOST, lossless: bool = True, ends: str = SENTENCE_ENDS) -> list[dict]:
    """Blocks -> chunks {text, section_path, page, block_type}, in order.

    A chunk's path is that above its last block, its page the first one there is, its type that of its first block; text longer
    than `most` is cut into sentence windows. Headings after all other blocks are a chunk without a page, under the path of what
    stands before them. A heading without a level (or of level 0) belongs to no path and is text.
    """
    rows = [b for b in blocks if (b.get("text") or "").strip()]
    kinds = ["heading" if b["type"] == "heading" and b.get("heading_level") else "table" if b["type"] == "table" else "text" for b in rows]
    marks = chunk_marks(kinds, [len(b["text"]) for b in rows], most)
    paths = section_paths(kinds, [b.get("heading_level") for b in rows], [b["text"] for b in rows])
    out = []
    for mark, members in groupby((i for i, m in enumerate(marks) if m), key=marks.__getitem__):
        own = [*members]
        text = "\n".join(rows[i]["text"] for i in own)
        pieces = sentence_windows(text, most, BACK, lossless, ends) if kinds[own[0]] == "text" and len(text) > most else [text]
        page = next((rows[i]["page"] for i in own if rows[i].get("page") is not None), None)
        out += [{"text": x, "section_path": paths[own[-1]], "page": page, "block_type": rows[own[0]]["type"]} for x in pieces if x.strip()]
    last = max((i for i, m in enumerate(marks) if m), default=-1)
    if last + 1 < len(rows):
        out.append({"text": "\n".join(b["text"] for b in rows[last + 1 :]), "section_path": paths[last] if last >= 0 else [], "page": None, "block_type": "heading"})
    return out


#: Documents whose chunks are Python objects at once; the blocks of one are at a time.
PART = 64
CHUNKS = "doc_id string, chunk_no int, chunk_id string, text string, section_path array<string>, page int, block_type string"


def chunk_structural(docs: DataFrame, most: int = MOST, lossless: bool = True, ends: str = SENTENCE_ENDS) -> DataFrame:
    """(doc_id, blocks) -> chunks numbered from 1 in each document; a document's blocks are one row."""

    types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.string())
    names = [x.split()[0] for x in CHUNKS.split(", ")]

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), PART):
                part, rows = batch.slice(at, PART), []
                for doc, blocks in zip(part.column(0), part.column(1), strict=True):
                    doc = doc.as_py()
                    rows += [(doc, i, f"{doc}:{i}", c["text"], c["section_path"], c["page"], c["block_type"]) for i, c in enumerate(structural(blocks.as_py() or [], most, lossless, ends), 1)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("string"), "blocks").mapInArrow(run, CHUNKS)


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Plain text as blocks: each line that is not blank a paragraph."""
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda s: F.trim(s) != "")
    block = lambda s: F.struct(F.lit("paragraph").alias("type"), s.alias("text"), F.lit(None).cast("int").alias("heading_level"), F.lit(None).cast("int").alias("page"))
    return docs.select(F.col(id_col).alias("doc_id"), F.transform(lines, block).alias("blocks"))


def indexed_text(section_path: str, text: str):
    """What is indexed of a chunk: its path, then its text."""
    path = F.array_join(section_path, " / ")
    return F.when(F.size(section_path) > 0, F.concat(path, F.lit("\n"), F.col(text))).otherwise(F.col(text))


STRATEGIES: dict[str, Callable[..., DataFrame]] = {"fixed": chunk_fixed, "structural": lambda docs, **kw: chunk_structural(paragraphs(docs), **kw)}


def chunk_by(strategy: str, docs: DataFrame, **options) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunk strategy {strategy!r}; there are {sorted(STRATEGIES)}")
    return STRATEGIES[strategy](docs, **options)


def markdown_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, block_no, type, heading_level, text of Markdown: headings, table lines (one block each), paragraphs.

    Lines of a paragraph belong together until a blank line, a heading or a table line; list markers are taken off.
    """
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\r\n|\r|\n")).alias("no", "line"))
    s = F.trim("line")
    kind = F.when(s == "", "blank").when(s.rlike(r"^#{1,6}\s"), "heading").when(s.startswith("|") & s.endswith("|") & (F.length(s) > 1), "table").otherwise("paragraph")
    from pyspark.sql import Window

    by = Window.partitionBy("doc_id").orderBy("no")
    marked = lines.withColumn("line", s).withColumn("type", kind)
    new = (F.col("type") != "paragraph") | (F.coalesce(F.lag("type").over(by), F.lit("blank")) != "paragraph")
    grouped = marked.withColumn("g", F.sum(new.cast("int")).over(by)).where("type <> 'blank'")
    text = F.regexp_replace(F.regexp_replace("line", r"^#{1,6}\s+", ""), r"^(?:[-*+]|[0-9]+[.)])\s+", "")
    level = F.when(F.col("type") == "heading", F.length(F.regexp_extract("line", "^(#+)", 1)))
    out = grouped.select("doc_id", "g", "no", "type", level.alias("heading_level"), F.when(F.col("type") == "table", F.col("line")).otherwise(text).alias("text"))
    joined = out.groupBy("doc_id", "g").agg(F.first("type").alias("type"), F.max("heading_level").alias("heading_level"), F.array_sort(F.collect_list(F.struct("no", "text"))).alias("parts"))
    numbered = joined.withColumn("block_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("g")))
    return numbered.select("doc_id", "block_no", "type", "heading_level", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page id, block_no, type, text of web pages: comments, scripts, styles and navigation out, a block at each block tag."""
    clean = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<head>.*?</head>|<nav>.*?</nav>", "")
    parts = F.split(F.regexp_replace(clean, r"<(h[1-6]|p|li|div|article|footer|body)[^>]*>", "\u0001$1\u0002"), "\u0001")
    rows = pages.select(F.col(id_col).alias("page_id"), F.posexplode(parts).alias("no", "part"))
    tag = F.regexp_extract("part", "^([a-z]+[1-6]?)\u0002", 1)
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("part", "^[a-z]+[1-6]?\u0002", ""), "<[^>]*>", " "), r"[ \t\r\n]+", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    out = rows.select("page_id", "no", F.when(tag.rlike("^h[1-6]$"), "heading").when(tag == "li", "list_item").otherwise("paragraph").alias("type"), F.trim(text).alias("text"))
    from pyspark.sql import Window

    return out.where("text <> ''").select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("no")).alias("block_no"), "type", "text")

"""Readers that say what became of each file or line: read, empty, skipped or failed, with the reason.

Files are read by Spark's own sources, which reach any store that Spark does and put many small files into one task; the
Python Data Source API would have to open them itself in the workers. A file that can't be parsed is a row with an error. Files of
no bytes at all are no rows, as Spark's file sources pass them over.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowdoc.functions.text import content_id
from sparrowdoc.sources.shared import exists
from sparrowdoc.sources.tables import PARSED, TEXT_CHARS

PROFILE = "profile.json"
OUTCOMES = ("read", "empty", "skipped", "failed")


def files_below(spark: SparkSession, root: str, suffixes: tuple[str, ...], recursive: bool = True, limit: int | None = None) -> DataFrame:
    """path, file (its name), suffix, content of the files with one of the suffixes; the first `limit` by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    out = files.select("path", name.alias("file"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("suffix"), "content").where(F.col("suffix").isin(*suffixes))
    return out.orderBy("path").limit(limit) if limit else out


def counts(rows: DataFrame) -> DataFrame:
    """One row: files, and how many of each outcome."""
    return rows.agg(F.count("*").alias("files"), *(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES))


# -- files that a parser reads ---------------------------------------------------------------------------------------------------


def parsed_by(files: DataFrame, parse: Callable[[bytes, str], str]) -> DataFrame:
    """files (path, suffix, content) -> path, doc_id (of the content), outcome, error, text.

    Of files of the same content the first by path is parsed, the others are skipped. parse(content, suffix) gives the text; what it
    raises is the error of that file alone. A file without text is empty.
    """
    own = files.withColumn("digest", F.sha2("content", 256))
    first = own.groupBy("digest").agg(F.min("path").alias("first"))
    marked = own.join(first, "digest").select("path", "suffix", "content", (F.col("path") != F.col("first")).alias("again"))

    def run(batches):
        for batch in batches:
            path, suffix, content, again = (batch.column(i) for i in range(4))
            out = []
            for i in range(len(batch)):
                if again[i].as_py():
                    out.append(("skipped", "duplicate", None))
                    continue
                try:
                    text = parse(content[i].as_py() or b"", suffix[i].as_py())
                    out.append(("read" if text and text.strip() else "empty", None, text))
                except Exception as error:  # whatever a parser raises is this file's outcome
                    out.append(("failed", f"{type(error).__name__}: {error}", None))
            columns = [pa.array(c, pa.string()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.string())] * 3
            yield pa.RecordBatch.from_arrays([path, *columns], names=["path", "outcome", "error", "text"])

    found = marked.mapInArrow(run, "path string, outcome string, error string, text string")
    return own.select("path", content_id("content").alias("doc_id")).join(found, "path")


# -- parsed documents ------------------------------------------------------------------------------------------------------------


def _json(text: Column) -> Column:
    """The text, where it is JSON in UTF-8; else null."""
    return F.when(F.is_valid_utf8(text) & F.try_parse_json(F.make_valid_utf8(text)).isNotNull(), text)


def parsed_documents(files: DataFrame, reader: str = "index", least: int = TEXT_CHARS) -> DataFrame:
    """files (file, content) of parsed documents, a JSON object each -> file, outcome, error, doc_id, title, text, blocks.

    Three readers differ in what they pass over. Blocks without text are left out of the text, which has a line for each other.

    * `index`: the profile is skipped; what is no JSON object or has no doc_id fails; a document without blocks is empty.
    * `items`: the profile, what is no JSON object, and texts of fewer than `least` characters (stripped) are skipped; one
      without a doc_id fails. The title is the file's stem where there is none.
    * `census`: what is no JSON is skipped; all else is read, the profile too, without a doc_id too.

    Nulls, empty contents and contents that are no UTF-8 are no JSON. Repeated rows each have a row.
    """
    if reader not in ("index", "items", "census"):
        raise ValueError(f"no reader {reader!r}")
    text = _json(F.col("content").cast("string"))
    rows = files.select("file", text.alias("json")).withColumn("d", F.from_json("json", PARSED))
    own = F.array_join(F.transform(F.filter("d.blocks", lambda b: F.coalesce(b["text"], F.lit("")) != ""), lambda b: b["text"]), "\n")
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    title = F.nullif(F.col("d.meta.title"), F.lit(""))
    out = rows.select("file", "json", F.col("d.meta.doc_id").alias("doc_id"), (F.coalesce(title, stem) if reader == "items" else title).alias("title"), F.coalesce(own, F.lit("")).alias("text"), F.coalesce("d.blocks", F.expr("array()")).alias("blocks"))
    object_ = F.col("json").rlike(r"^\s*\{")
    broken, nameless, profile = F.coalesce(~object_, F.lit(True)), F.col("doc_id").isNull(), F.col("file") == PROFILE
    short = F.length(F.regexp_replace("text", r"(?U)^\s+|\s+$", "")) < least
    rule = {
        "index": F.when(profile, "skipped: profile").when(broken, "failed: no JSON object").when(nameless, "failed: no doc_id").when(F.size("blocks") == 0, "empty: no blocks"),
        "items": F.when(profile, "skipped: profile").when(broken, "skipped: no JSON object").when(short, "skipped: short").when(nameless, "failed: no doc_id"),
        "census": F.when(F.col("json").isNull(), "skipped: no JSON"),
    }[reader]
    said = F.split(F.coalesce(rule, F.lit("read")), ": ")
    return out.select("file", said[0].alias("outcome"), F.get(said, F.lit(1)).alias("error"), "doc_id", "title", "text", "blocks")


# -- lines -----------------------------------------------------------------------------------------------------------------------


def json_lines(spark: SparkSession, path: str, schema: str, needed: tuple[str, ...] = ()) -> DataFrame:
    """One row for each line of JSON-lines files: file, outcome, error, line (of what failed), and record of the schema.

    Blank lines are skipped; lines that are no JSON object, or lack one of the needed fields, fail. A path that isn't there has no
    lines. One field that does not fit its type is null, and fails if it is needed.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], f"file string, outcome string, error string, line string, record struct<{_fields(spark, schema)}>")
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value"))
    rows = rows.withColumn("json", _json(F.col("value"))).withColumn("record", F.from_json("json", schema))
    lacks = F.lit(None).cast("string")
    for field in reversed(needed):
        lacks = F.when(F.col("record")[field].isNull(), F.lit(f"failed: no {field}")).otherwise(lacks)
    rule = F.when(F.trim(F.regexp_replace("value", r"\s", " ")) == "", "skipped: blank").when(~F.coalesce(F.col("json").rlike(r"^\s*\{"), F.lit(False)), "failed: no JSON object").otherwise(lacks)
    said = F.split(F.coalesce(rule, F.lit("read")), ": ")
    return rows.select("file", said[0].alias("outcome"), F.get(said, F.lit(1)).alias("error"), F.when(said[0] == "failed", F.col("value")).alias("line"), F.when(said[0] == "read", F.col("record")).alias("record"))


def _fields(spark: SparkSession, schema: str) -> str:
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in spark.createDataFrame([], schema).schema)


def records(lines: DataFrame) -> DataFrame:
    """The records of the lines that were read."""
    return lines.where("outcome = 'read'").select("record.*")

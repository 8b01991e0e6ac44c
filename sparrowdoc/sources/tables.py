"""Readers and sinks: file scans, tolerant JSON, keyed tables with upsert and delete, caches, registries."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowdoc.functions.text import content_id
from sparrowdoc.operators.places import placed

TEXT_CHARS = 120  # documents with fewer characters give no evaluation items


def scan_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("pdf", "docx", "doc"), limit: int | None = None) -> DataFrame:
    """path, suffix, length, content of all files below root with one of the suffixes, by path; the first `limit`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    out = files.withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).where(F.col("suffix").isin(*suffixes))
    out = out.select("path", "suffix", "length", "content")
    return out.orderBy("path").limit(limit) if limit else out


def first_of_each(rows: DataFrame, content: str, order: str) -> DataFrame:
    """rows with doc_id (from the content) and is_duplicate: not the first in order with its content.

    The first of a content is an aggregate, so that a content with very many rows is no task's burden.
    """
    keyed = rows.withColumn("content_key", F.sha2(F.col(content), 256))
    first = keyed.groupBy("content_key").agg(F.min(order).alias("first_in_order"))
    out = keyed.join(first, "content_key").withColumn("doc_id_by_content", content_id(content))
    return out.withColumn("is_duplicate", F.col(order) != F.col("first_in_order")).drop("first_in_order")


def parsing_outcome(chars: str, pages: str, images: str, ocr_text: str, least: int = 50):
    """What a parsed file's text comes from: text, near_empty, ocr_applied or ocr_unavailable."""
    per_page = F.col(chars) / F.greatest(F.col(pages), F.lit(1))
    return (
        F.when(per_page >= least, "text").when(F.col(images) == 0, "near_empty").when(F.col(ocr_text).isNotNull(), "ocr_applied").otherwise("ocr_unavailable")
    )


BLOCK = "struct<type:string,text:string,heading_level:int,page:int,bbox:array<double>,source:string>"
META = "struct<source_type:string,doc_id:string,title:string,owner:string,created_at:string,edited_at:string,ocr_status:string>"
PARSED = f"meta {META}, blocks array<{BLOCK}>"


def read_parsed(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Parsed documents (a JSON file each): those that parse, and one row of counts: documents, failed, empty."""
    raw = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").schema(f"{PARSED}, corrupt string").json(root)
    raw = raw.withColumn("file", F.col("_metadata.file_name")).where("file <> 'profile.json'")
    text = F.array_join(F.filter(F.transform("blocks", lambda b: b["text"]), lambda t: F.trim(t) != ""), "\n")
    good = raw.where("corrupt is null and meta.doc_id is not null").withColumn("text", F.coalesce(text, F.lit("")))
    counts = raw.agg(F.count("*").alias("documents"), F.count_if(F.expr("corrupt is not null or meta.doc_id is null")).alias("failed"), F.count_if(F.coalesce(F.length(text), F.lit(0)) == 0).alias("empty"))
    return good.drop("corrupt"), counts


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are no rows."""
    return spark.createDataFrame([], schema) if not path else spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema).alias("r")).select("r.*")


def upserted(table: DataFrame, incoming: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """table with all rows of the incoming keys replaced by the incoming rows.

    With an order, the incoming rows are one for each key: the last. Columns are matched by name.
    """
    if order:
        last = Window.partitionBy(key).orderBy(F.desc(order))
        incoming = incoming.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    return table.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def deleted(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def backfilled(table: DataFrame, values: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """table with columns set from values where these are not NULL."""
    new = values.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    out = table.join(new, key, "left")
    return out.withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in columns}).drop(*(f"__{c}" for c in columns))


def replace_table(df: DataFrame, name: str, by: list[str] | None = None) -> None:
    """Drops and creates a table."""
    writer = df.write.mode("overwrite").format("parquet")
    (writer.partitionBy(*by) if by else writer).saveAsTable(name)


def append_results(df: DataFrame, path: str, run_id: str) -> None:
    """Appends a run's rows; a run's rows are read back by run_id."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def documents_of_passages(passages: DataFrame, text: str) -> DataFrame:
    """One parsed document for each distinct passage: doc_id and its single block."""
    block = F.struct(F.lit("paragraph").alias("type"), F.col("text"))
    return passages.select(F.col(text).alias("text")).where("text is not null").distinct().select(content_id("text").alias("doc_id"), F.array(block).alias("blocks"))


def cache_inventory(cache: DataFrame) -> DataFrame:
    """Entries of a response cache by model: how many, the first and the last, most first."""
    return cache.groupBy("model").agg(F.count("*").alias("entries"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at")).orderBy(F.desc("entries"), "model")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, lines, sha256 of each file of a folder: what a download must agree with."""
    files = spark.read.format("binaryFile").load(path)
    lines = F.size(F.split(F.decode("content", "UTF-8"), "\n")) - F.when(F.decode("content", "UTF-8").endswith("\n"), 1).otherwise(0)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), lines.alias("lines"), F.sha2("content", 256).alias("sha256"))


# -- profile of files by their pages --------------------------------------------------------------------------------------------

#: A page of fewer characters is near empty; a file of fewer characters a page is suspected to be scanned.
EMPTY_PAGE, SCAN_PAGE = 20, 50


def page_profile(pages: DataFrame, file: str = "file", text: str = "text", images: str = "images") -> DataFrame:
    """pages (file, text, images), as a parser gives them -> one row a file: pages, chars_per_page, near_empty_pages, images, and
    whether it is suspect, and then likely a scan (it has images) or near empty (it has none)."""
    n = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", ""))
    out = pages.groupBy(file).agg(F.count("*").alias("pages"), F.round(F.sum(n) / F.count("*"), 1).alias("chars_per_page"), F.count_if(n < EMPTY_PAGE).alias("near_empty_pages"), F.sum(F.coalesce(images, F.lit(0))).cast("long").alias("images"))
    suspect = F.col("chars_per_page") < SCAN_PAGE
    return out.withColumn("scan_suspect", suspect).withColumn("scan_likely", suspect & (F.col("images") > 0)).withColumn("near_empty", suspect & (F.col("images") == 0))


def suffix_counts(files: DataFrame, path: str = "path") -> DataFrame:
    """suffix (lower-cased, `none` without one), files; names that begin with a dot are passed over."""
    name = F.element_at(F.split(path, "/"), -1)
    suffix = F.coalesce(F.nullif(F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)), F.lit("")), F.lit("none"))
    return files.where(~name.startswith(".")).groupBy(suffix.alias("suffix")).agg(F.count("*").alias("files"))


def outcomes_with_names(rows: DataFrame, outcome: str, name: str) -> DataFrame:
    """outcome, n, no, name: each name as a row, with its place (from 1) in its outcome and the number of rows there. NULL outcomes
    are one, NULL names come first in theirs.

    Places are counted by ranges of outcome and name together, so that an outcome of any size is the work of many tasks.
    """
    kinds = rows.groupBy(outcome).agg(F.count("*").alias("n")).withColumnRenamed(outcome, "__kind")
    key = F.concat_ws("", F.coalesce(F.col(outcome), F.lit("")), F.lit("\u0000"), F.when(F.col(outcome).isNull(), "0").otherwise("1"), F.coalesce(F.col(name), F.lit("")))
    own = placed(rows.select(outcome, name, key.alias("__key")), ["__key", name], "__at")
    first = own.groupBy(outcome).agg(F.min("__at").alias("__first")).withColumnRenamed(outcome, "__own")
    joined = own.join(F.broadcast(first), F.col(outcome).eqNullSafe(F.col("__own"))).join(F.broadcast(kinds), F.col(outcome).eqNullSafe(F.col("__kind")))  # a row for each outcome
    return joined.select(outcome, "n", (F.col("__at") - F.col("__first") + 1).alias("no"), name)


# -- a keyed cache as a table ----------------------------------------------------------------------------------------------------


def cache_put(cache: DataFrame, entries: DataFrame, key: str = "key", order: str = "at") -> DataFrame:
    """The cache with entries; an entry replaces one of its key, the latest of several holds."""
    last = entries.groupBy(key).agg(F.max_by(F.struct(*entries.columns), order).alias("e")).select("e.*")
    return cache.join(last.select(key), key, "left_anti").unionByName(last)


def cache_get(cache: DataFrame, asked: DataFrame, key: str = "key") -> DataFrame:
    """asked keys with what the cache has, and whether it is a hit."""
    return asked.join(cache.withColumn("hit", F.lit(True)), key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def cache_clear(cache: DataFrame, model: str | None = None) -> DataFrame:
    """What stays: nothing, or all but a model's entries."""
    return cache.where(F.lit(False)) if model is None else cache.where(~F.col("model").eqNullSafe(F.lit(model)))


def load_registry(spark: SparkSession, path: str, schema: str = "name string, fingerprint string") -> DataFrame:
    """A registry of fingerprints; a file that is missing or is no JSON of these fields is an empty one."""
    empty = spark.createDataFrame([], schema)
    try:
        lines = spark.read.text(path).where(F.trim("value") != "")
        rows = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").isNull().alias("bad"))
        return empty if rows.where("bad").limit(1).count() else rows.select("r.*")
    except AnalysisException:  # no such path
        return empty


def save_registry(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").json(path)

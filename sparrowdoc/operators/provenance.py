"""What a result was made from: fingerprints, freezes, resumption, reconciliation, pruning, keyed caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DecimalType, DoubleType, FloatType, IntegralType, MapType, StructType

VERSION = "v1"


def fingerprint(**parts: Column) -> Column:
    """16 hex digits over named values, in the order of their names; NULL and empty differ. The format has a version."""
    rendered = [F.concat(F.lit(f"{name}="), F.coalesce(F.concat(F.lit('"'), value.cast("string"), F.lit('"')), F.lit("null"))) for name, value in sorted(parts.items())]
    return F.substring(F.sha2(F.concat_ws("\n", F.lit(VERSION), *rendered), 256), 1, 16)


def corpus_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents, characters and a fingerprint of a corpus that its order does not change: sums of row hashes, no gathering."""
    row = F.sha2(F.concat_ws("\n", F.col(id_col).cast("string"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)), 256)
    low = F.conv(F.substring(row, 1, 12), 16, 10).cast("long")
    totals = docs.agg(F.count("*").alias("documents"), F.sum(F.length(text_col)).alias("characters"), F.sum(low.cast("decimal(38,0)")).cast("string").alias("total"))
    return totals.select("documents", "characters", fingerprint(documents=F.col("documents"), characters=F.col("characters"), total=F.col("total")).alias("fingerprint"))


def freeze_id(**fingerprints: Column) -> Column:
    return F.substring(fingerprint(**fingerprints), 1, 12)


def frozen(freezes: DataFrame, run: DataFrame, relevant: list[str]) -> DataFrame:
    """run with a warning where freezes exist and none has its relevant fingerprints; silent without freezes."""
    n = freezes.select(F.count("*").alias("n_freezes"))
    known = freezes.select(*relevant).distinct().withColumn("__known", F.lit(True))
    out = run.join(known, relevant, "left").crossJoin(F.broadcast(n))
    return out.withColumn("warns", (F.col("n_freezes") > 0) & F.col("__known").isNull()).drop("__known", "n_freezes")


def reconcile(stored: DataFrame, keep: DataFrame, key: str = "doc_id", chunks: str = "chunks") -> tuple[DataFrame, DataFrame, DataFrame]:
    """stored (key, chunks) against keep (key): orphans, missing, and one row of counts."""
    orphans = stored.join(keep.select(key).distinct(), key, "left_anti")
    missing = keep.select(key).distinct().join(stored, key, "left_anti")
    o = orphans.agg(F.count("*").alias("orphans"), F.coalesce(F.sum(chunks), F.lit(0)).alias("orphan_chunks"))
    m = missing.agg(F.count("*").alias("missing"))
    s = stored.agg(F.count("*").alias("stored"), F.coalesce(F.sum(chunks), F.lit(0)).alias("stored_chunks"))
    k = keep.agg(F.countDistinct(key).alias("kept"))
    return orphans, missing, o.crossJoin(m).crossJoin(s).crossJoin(k)  # one row each


def prune_decision(counts: DataFrame, yes: Column, failures: Column) -> DataFrame:
    """What becomes of orphans: nothing to do, report, refuse (failures, or more orphans than kept), or delete."""
    what = F.when(F.col("orphans") == 0, "nothing").when(~yes, "report").when(failures > 0, "refuse: failures").when(F.col("orphans") > F.col("kept"), "refuse: too many").otherwise("delete")
    return counts.withColumn("decision", what)


def resume(items: DataFrame, done: DataFrame, key: str, failed: Column) -> tuple[DataFrame, DataFrame]:
    """Results to reuse (done without an error), and items still to do."""
    good = done.where(~failed)
    return good.join(items.select(key).distinct(), key, "left_semi"), items.join(good.select(key).distinct(), key, "left_anti")


def cached_or(rows: DataFrame, cache: DataFrame, key: str, value: str, computed: Column) -> DataFrame:
    """A cached value of the key, or else the computed one, and whether it was cached."""
    own = cache.groupBy(key).agg(F.max_by(value, "created_at").alias("__v"))
    out = rows.join(own, key, "left")
    return out.withColumn("cached", F.col("__v").isNotNull()).withColumn(value, F.coalesce("__v", computed)).drop("__v")


def latest(table: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last write of each key."""
    window = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return table.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")


#: HTTP statuses after which a call is worth repeating.
RETRYABLE = (408, 409, 429, 500, 502, 503, 504)


def retryable(status: Column, transport_error: Column) -> Column:
    return F.coalesce(status.isin(*RETRYABLE), F.lit(False)) | F.coalesce(transport_error, F.lit(False))


# -- canonical JSON --------------------------------------------------------------------------------------------------------------

#: Escapes of a JSON string that have a letter.
ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))


def _json_text(c: Column) -> Column:
    out = c
    for raw, escaped in ESCAPES:
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    rare = out
    for i in range(0x20):
        rare = F.replace(rare, F.lit(chr(i)), F.lit(f"\\u{i:04x}"))
    return F.concat(F.lit('"'), F.when(c.rlike(r"[\x00-\x1f]"), rare).otherwise(out), F.lit('"'))


def _json_number(c: Column) -> Column:
    """A double by the fewest digits that give it back: plain from 1e-4 to 1e16, else with an exponent of two digits at least.
    Where it takes 16 or 17 of them, Java may choose another last digit than other writers, of those that give the same double; and of
    the very smallest subnormal numbers it shows two digits."""
    forms = [F.format_string(f"%.{k}e", c) for k in (14, 15, 16)]
    shown = F.coalesce(*(F.when(f.cast("double") == c, f) for f in forms[:2]), forms[2])
    sign, e = F.when(shown.startswith("-"), "-").otherwise(""), F.regexp_extract(shown, r"e([+-][0-9]+)$", 1).cast("int")
    d = F.regexp_replace(F.replace(F.regexp_extract(shown, r"^-?([0-9.]+)", 1), F.lit("."), F.lit("")), r"(?<=.)0+$", "")
    rest = lambda n: F.nullif(F.substring(d, n, F.length(d)), F.lit(""))
    whole = F.concat(F.rpad(F.substring(d, F.lit(1), e + 1), e + 1, F.lit("0")), F.lit("."), F.coalesce(rest(e + 2), F.lit("0")))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d)
    size = F.abs(e).cast("string")
    power = F.concat(F.substring(d, 1, 1), F.coalesce(F.concat(F.lit("."), rest(F.lit(2))), F.lit("")), F.when(e < 0, "e-").otherwise("e+"), F.lpad(size, F.greatest(F.lit(2), F.length(size)), F.lit("0")))
    plain = F.when(e.between(0, 15), whole).when(e.between(-4, -1), small).otherwise(power)
    return F.when(F.isnan(c), "NaN").when(F.abs(c) == float("inf"), F.when(c < 0, "-Infinity").otherwise("Infinity")).otherwise(F.concat(sign, plain))


def canonical_json(c: Column, kind: DataType) -> Column:
    """A column of any type as JSON with sorted keys, `, ` and `: ` between, characters outside ASCII as they are; equal values have equal
    texts, whatever the order of fields or map entries. Null is `null`; keys of maps are shown as strings; other types are
    strings."""
    if isinstance(kind, StructType):
        fields = [F.concat(_json_text(F.lit(f.name)), F.lit(": "), canonical_json(c[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        shown = F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))
    elif isinstance(kind, MapType):
        entries = F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].cast("string").alias("k"), canonical_json(e["value"], kind.valueType).alias("v"))))
        shown = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(_json_text(e["k"]), F.lit(": "), e["v"])), ", "), F.lit("}"))
    elif isinstance(kind, ArrayType):
        shown = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical_json(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, (FloatType, DoubleType)):
        shown = _json_number(c.cast("double"))
    elif isinstance(kind, (IntegralType, BooleanType, DecimalType)):
        shown = c.cast("string")
    else:
        shown = _json_text(c.cast("string"))
    return F.when(c.isNull(), F.lit("null")).otherwise(shown)


def canonical(rows: DataFrame, *columns: str) -> Column:
    """The named columns of rows as one JSON object."""
    return canonical_json(F.struct(*columns), rows.select(F.struct(*columns).alias("s")).schema["s"].dataType)


def state_fingerprint(rows: DataFrame, *columns: str, digits: int = 16) -> Column:
    """The first digits of the SHA-256 of the columns as canonical JSON."""
    return F.substring(F.sha2(canonical(rows, *columns), 256), 1, digits)


#: What identifies an index, the version of its rows, and the columns that identify how answers were made.
INDEX_COLUMNS, PAYLOAD_SCHEMA = ("collection", "n_points", "n_chunks", "embed_model", "chunk_strategy", "bm25_strategy"), "2"


def index_fingerprint(rows: DataFrame) -> Column:
    """16 digits of an index' state, from INDEX_COLUMNS of rows and the version of its rows."""
    own = rows.withColumn("payload_schema", F.lit(PAYLOAD_SCHEMA))
    kind = own.select(F.struct(*INDEX_COLUMNS, "payload_schema").alias("s")).schema["s"].dataType
    return F.substring(F.sha2(canonical_json(F.struct(*INDEX_COLUMNS, F.lit(PAYLOAD_SCHEMA).alias("payload_schema")), kind), 256), 1, 16)


def prompt_fingerprint(*texts: str) -> Column:
    """12 digits over the texts that a prompt is made of, in order."""
    return F.substring(F.sha2(F.concat_ws("\0", *(F.coalesce(F.col(c), F.lit("")) for c in texts)), 256), 1, 12)

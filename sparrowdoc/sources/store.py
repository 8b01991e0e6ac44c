"""A keyed table in hash buckets: upsert, delete and backfill rewrite the buckets they touch, lookups read few row groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowdoc.sources.shared import delete, exists

BUCKET = "bucket"
#: Keys of a lookup that are put into the filter of the scan; more of them are joined.
FEW_KEYS = 1000


class KeyedTable:
    """Rows by a key, at `path`: a folder for each bucket (a hash of the key), files sorted by key with Bloom filters on it.

    An update reads and writes the buckets of its keys alone, and replaces them when all of them are written; the other
    buckets' files stay as they are. An update that is broken off and repeated gives the table of one that was not. There is
    one writer at a time. Rows with a null key are in a bucket of their own and are not touched by updates.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64, row_group_bytes: int = 8 << 20):
        self.spark, self.path, self.key, self.buckets, self.row_group_bytes = spark, path.rstrip("/"), key, buckets, row_group_bytes

    def bucket(self, key: Column | str | None = None) -> Column:
        c = F.col(self.key) if key is None else F.col(key) if isinstance(key, str) else key
        return F.when(c.isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int"))

    def _rows(self) -> DataFrame:
        """All rows, with their bucket; the schema is kept beside them, so that a table without rows can be read."""
        kept = self.spark.read.parquet(f"{self.path}/_schema").schema
        return self.spark.read.schema(kept.add(BUCKET, "integer")).parquet(self.path)

    def read(self) -> DataFrame:
        return self._rows().drop(BUCKET)

    def _write(self, rows: DataFrame, mode: str) -> None:
        # a rebalanced bucket may be several tasks, if it is large
        out = rows.withColumn(BUCKET, self.bucket()).hint("rebalance", F.col(BUCKET)).sortWithinPartitions(BUCKET, self.key)
        writer = out.write.mode(mode).partitionBy(BUCKET).option("parquet.block.size", self.row_group_bytes)
        if dict(rows.dtypes)[self.key] in ("string", "bigint", "int"):
            writer = writer.option(f"parquet.bloom.filter.enabled#{self.key}", "true")
        (writer.option("partitionOverwriteMode", "dynamic") if mode == "overwrite" else writer).parquet(self.path)

    def create(self, rows: DataFrame) -> KeyedTable:
        """The table of these rows; what was at the path goes."""
        delete(self.spark, self.path)
        self._write(rows, "append")
        rows.limit(0).write.parquet(f"{self.path}/_schema")
        return self

    def _touched(self, keys: DataFrame) -> list[int]:
        """Buckets of the keys, at most as many as there are."""
        return sorted(r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect() if r[0] >= 0)

    def _replace(self, touched: list[int], rows: DataFrame) -> None:
        """rows instead of those of the touched buckets. Buckets that get no rows are removed."""
        left = {r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect()}
        self._write(rows, "overwrite")
        for b in set(touched) - left:
            delete(self.spark, f"{self.path}/{BUCKET}={b}")

    def _in(self, touched: list[int]) -> DataFrame:
        return self._rows().where(F.col(BUCKET).isin(*touched)).drop(BUCKET)

    def upsert(self, incoming: DataFrame, order: str | None = None) -> None:
        """All rows of the incoming keys replaced by the incoming rows; with an order, by the last one of each key. Null keys are
        left out."""
        incoming = incoming.where(F.col(self.key).isNotNull())
        if order:
            incoming = incoming.groupBy(self.key).agg(F.max_by(F.struct(*incoming.columns), order).alias("r")).select("r.*")
        touched = self._touched(incoming)
        if touched:
            rest = self._in(touched).join(incoming.select(self.key).distinct(), self.key, "left_anti")
            self._replace(touched, rest.unionByName(incoming))

    def delete(self, keys: DataFrame) -> None:
        touched = self._touched(keys)
        if touched:
            self._replace(touched, self._in(touched).join(keys.select(self.key).distinct(), self.key, "left_anti"))

    def backfill(self, values: DataFrame, columns: list[str]) -> None:
        """Columns set from values (one row a key) where these are not null; values of keys that the table does not have are left
        out, and buckets without a key of the table stay."""
        touched = self._touched(values)
        if not touched:
            return
        touched = self._touched(self._in(touched).join(values.select(self.key), self.key, "left_semi"))
        new = values.select(self.key, *(F.col(c).alias(f"__{c}") for c in columns))
        rows = self._in(touched)
        out = rows.join(new, self.key, "left").withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in columns})
        if touched:
            self._replace(touched, out.select(*rows.columns))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of the keys. Few keys are a filter of the scan, which then opens their buckets alone and of these the row groups
        that can have them; more are joined, still with their buckets alone."""
        own = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        some = own.limit(FEW_KEYS + 1).collect()
        rows = self._in(self._touched(own))
        return rows.where(F.col(self.key).isin(*(r[0] for r in some))) if len(some) <= FEW_KEYS else rows.join(own, self.key, "left_semi")

    def exists(self) -> bool:
        return exists(self.spark, f"{self.path}/_schema")

"""Shared pieces of the corpus operators: byte-level views of Arrow text, rolling hashes, written scratch tables."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: An odd multiplier and its inverse modulo 2**64, for polynomial hashes that can be cut anywhere.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

LOW = 12


@functools.cache
def _power_tables(base: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i for i below 2**LOW, and base**(i * 2**LOW) for i below `high`."""

    def table(b: int, n: int) -> np.ndarray:
        out = np.ones(n, U64)
        done = 1
        while done < n:
            step = min(done, n - done)
            out[done : done + step] = out[:step] * U64(pow(b, done, 1 << 64))
            done += step
        return out

    return table(base, 1 << LOW), table(pow(base, 1 << LOW, 1 << 64), high)


def _tables_for(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _power_tables(base, max(1 << LOW, 1 << ((n >> LOW) + 1).bit_length()))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; what is kept between calls is a few thousand numbers."""
    low, high = _tables_for(base, n)
    return (high[: (n >> LOW) + 1, None] * low).ravel()[:n]


def powers_at(base: int, at: np.ndarray, n: int) -> np.ndarray:
    """base**at modulo 2**64 for an array of exponents below n."""
    low, high = _tables_for(base, n)
    return high[at >> LOW] * low[at & ((1 << LOW) - 1)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); returns a new array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (1 << 64) - 1], U64))[0])


class Rolling:
    """Prefix sums of a byte array from which the hash of any slice follows in one step."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, U64)
        term = data.astype(U64)
        term += U64(1)
        term *= powers(BASE, n)
        np.cumsum(term, out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of data[start:end], for arrays of positions; the length is part of the hash."""
        out = self.sums[end] - self.sums[start]
        out *= powers_at(INVERSE, start, len(self.sums))
        out ^= (end - start).astype(U64) * U64(0xD6E8FEB86659FD93)
        return mix(out)

    def windows(self, k: int) -> np.ndarray:
        """Mixed hashes of all slices of length k."""
        n = len(self.sums) - k
        if n <= 0:
            return np.empty(0, U64)
        out = self.sums[k:] - self.sums[:n]
        out *= powers(INVERSE, n)
        return mix(out)


def space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


SPACE = space_table()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Bytes of text that are worked on at once; the arrays made of them take many times that.
RUN_BYTES = 1 << 18


def views(batch: pa.RecordBatch, column: int, most: int = RUN_BYTES, rows: int = 4000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a batch into runs of rows of about `most` bytes of text: (first row, row after the last, bytes, offsets).

    Null texts count as empty. A single text over the limit is a run of its own, whole.
    """
    col = batch.column(column)
    if col.null_count:
        col = pc.fill_null(col, pa.scalar(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "", col.type))
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if not n:
        return
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), n, at + rows)
        part = offsets[at : to + 1]
        yield at, to, raw[part[0] : part[-1]], part - part[0]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, ink: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes other than space and \\t..\\r, or of those marked in `ink`; runs end with
    their row."""
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, none
    ink = ~SPACE[data] if ink is None else ink
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    cut = offsets[:-1][offsets[:-1] < n]
    first[cut] = ink[cut]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    cut = offsets[1:][offsets[1:] > 0] - 1
    last[cut] = ink[cut]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def cut_out(data: np.ndarray, start: np.ndarray, end: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """The slices data[start:end], which do not overlap and are in order, as a binary array."""
    size = end - start
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.Array.from_buffers(kind or pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))])


def numbered(slices: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Equal numbers for equal slices, exactly, and the slice of each number."""
    coded = slices.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word."""
    start, end, row = words(data, offsets)
    return Rolling(data).slices(start, end), row


def grams(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of n words inside a row, the row of each, and the index of its first word."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(row[:size] == row[n - 1 :])
    out = np.zeros(len(at), U64)
    for i in range(n):
        out = mix(out * U64(BASE) + hashes[at + i] + U64(i + 1))
    return out, row[at], at


def row_counts(row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, minlength=n).astype(np.int64)


def ordered_repeat(keys: np.ndarray) -> np.ndarray:
    """keys sorted, the i-th repeat of a value moved to a value of its own: a multiset as a set."""
    keys = np.sort(keys)
    if len(keys) < 2:
        return keys
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    if new.all():
        return keys
    run = np.arange(len(keys)) - np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    again = run > 0
    keys[again] = mix(keys[again] + run[again].astype(U64) * U64(BASE))
    return np.sort(keys)


# -- a worker's memory --------------------------------------------------------------------------------------------------

#: Rows and bytes of an Arrow batch that workers are sent: long texts make batches small.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, where they are larger: a batch is held by the JVM and by its worker at once."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(name))
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def tidy(run):
    """A function of batches that gives memory back to the system when its task ends; workers live on for other tasks."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # another C library
                pass

    return tidied


# -- scratch tables ---------------------------------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see. Without the setting a local session gets a temporary
    folder; on a cluster executors would not share one, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    had = context._jsc.sc().getCheckpointDir()
    if had.isDefined():
        return had.get()
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = tempfile.mkdtemp(prefix="sparrowdoc-")
    atexit.register(shutil.rmtree, found, ignore_errors=True)
    context.setCheckpointDir(found)
    return found


class Scratch:
    """Intermediate tables written as Parquet to the shared folder: cuts lineage, survives lost executors.

    close() removes all tables but those that a lazy result still reads; these go when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/sparrow-{uuid.uuid4().hex}"
        self.count, self.held = 0, set()
        atexit.register(self._end)

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._sparrow_path = path
        self.held.add(path)
        return out

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def drop(self, df: DataFrame) -> None:
        """Removes a table that no later plan reads."""
        path = getattr(df, "_sparrow_path", None)
        if path in self.held:
            self.held.discard(path)
            self._delete(path)

    def close(self, *needed: DataFrame) -> None:
        """Removes every table but those needed."""
        stay = {getattr(df, "_sparrow_path", None) for df in needed}
        for path in self.held - stay:
            self.held.discard(path)
            self._delete(path)

    def _end(self) -> None:
        if self.held and not self.spark.sparkContext._jsc.sc().isStopped():
            try:
                self._delete(self.root)
            except Exception:  # the gateway may end before Python does; the folder's owner clears it then
                pass


# -- a set of bounded size ----------------------------------------------------------------------------------------------

#: Bits of a hashed set: 2 MB whatever the input. A full set only lets more rows through; it never loses one.
SET_BITS = 24


def hashed_set(df: DataFrame, column: str, bits: int = SET_BITS) -> np.ndarray:
    """2**bits bits of the values of a long column, gathered as words of 64."""
    at = F.expr(f"pmod({column}, {1 << bits})")
    rows = df.select(at.alias("b")).groupBy(F.expr("b div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("v")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows.column("w").to_numpy()] = rows.column("v").to_numpy()
    return out.view(U64)


def in_set(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values.view(U64) & U64(64 * len(bits) - 1)
    return (bits[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1


# -- links to classes ---------------------------------------------------------------------------------------------------


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """links (a, b) of longs, a written table -> (id, root): the smallest id of each connected component, for every linked id.

    Alternates the large-star and small-star steps until every id has one edge, to a root that has none: stars of a
    component's ids, which the steps leave as they are. Each step is an aggregation and a join, so that no component is
    gathered in one task; each result is a written table.
    """
    # every step has edges from larger to smaller ids
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).where("a <> b").distinct()
        new = scratch.keep(small)
        scratch.drop(edges)
        edges = new
        ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty():
            break
    ids = edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return ids.union(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def merged(scratch: Scratch, roots: DataFrame, links: DataFrame) -> DataFrame:
    """components() of all links so far, written: of those that gave roots (id, root) and of the new links (a, b). Classes are
    single ids here, so that the steps meet the new links alone."""
    of = lambda end: roots.select(F.col("id").alias(end), F.col("root").alias(f"r{end}"))
    raised = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    steps = scratch.keep(raised)
    found = components(scratch, steps)
    scratch.drop(steps)
    up = roots.join(found.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    return scratch.keep(up.union(found.join(roots, "id", "left_anti").select("id", "root")))

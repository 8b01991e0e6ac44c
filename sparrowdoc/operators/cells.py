"""A stored vector index: coarse cells with residual codes, probing, and an exact second pass.

Vectors are brought to length 1. Centres of cells, and code books for what is left of a vector without its cell's centre, are
fitted on SAMPLE rows at most (those of the smallest hashes of their ids); every row is then filed, in the folder of its nearest
centre, with its code (one byte for each WIDTH dimensions) beside the vector itself.

A search compares a query with the rows of its `probes` nearest cells by their codes, which are read alone; the best
k * `refine` of them are compared exactly. How many of both are needed is measured on the sample: vectors without clusters need
most cells. With exact=True all cells are probed and all rows compared by their vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowdoc.operators.retrieve import BLOCK, Best, _unit, dense_topk, ranked
from sparrowdoc.sources.shared import Workspace, delete

SAMPLE, WIDTH, CODES, ROUNDS, SEED = 20_000, 4, 256, 12, 7
#: Sample queries, their nearest rows, and the share of these that the model's own numbers of probes and refined rows must each hold.
TUNED, NEAREST, SHARE = 200, 10, 0.98
#: Most cells; bytes of queries of a broadcast piece, and rows that a task holds for one; rows that are decoded at once.
CELLS, PIECE_BYTES, PIECE_ROWS, ROWS = 4096, 32 << 20, 1 << 20, 2048


def _centres(x: np.ndarray, n: int, unit: bool) -> np.ndarray:
    """n centres of the rows of x by Lloyd's rounds; an empty cell takes up a row that is far from its centre."""
    rng = np.random.default_rng(SEED)
    n = min(n, len(x))
    out = x[rng.choice(len(x), n, replace=False)].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, out)
        count = np.bincount(near, minlength=n)
        sums = np.zeros_like(out)
        np.add.at(sums, near, x)
        out = sums / np.maximum(count, 1)[:, None]
        empty = np.flatnonzero(count == 0)
        if len(empty):
            far = np.argsort(-((x - out[near]) ** 2).sum(axis=1), kind="stable")[: len(empty)]
            out[empty] = x[far]
        if unit:
            norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
            out /= np.where(norm == 0, 1, norm)
    return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[a : a + ROWS] @ centres.T - half, axis=1) for a in range(0, len(x), ROWS)]) if len(x) else np.empty(0, np.int64)


class Model:
    """Centres of cells and code books; of fixed size."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.dim = sample.shape[1]
        self.centres = _centres(sample, max(1, cells), True) if len(sample) else np.zeros((1, self.dim))
        rest = sample - self.centres[_nearest(sample, self.centres)]
        parts = range(0, self.dim, WIDTH)
        self.probes, self.refine = len(self.centres), 1
        self.books = [_centres(rest[:, a : a + WIDTH], CODES, False) if len(rest) else np.zeros((1, min(WIDTH, self.dim - a))) for a in parts]

        if len(sample) > 1:
            self._tune(sample)

    def _tune(self, sample: np.ndarray) -> None:
        """How many cells and how many rows by code must be looked at for SHARE of the sample's nearest rows, each."""
        asked = np.arange(0, len(sample), max(1, len(sample) // TUNED))[:TUNED]
        cell, code = self.encoded(sample)
        near, rough = sample[asked] @ sample.T, sample[asked] @ self.decoded(cell, code).T
        for x in (near, rough):
            x[np.arange(len(asked)), asked] = -np.inf
        k = min(NEAREST, len(sample) - 1)
        true = np.argpartition(-near, k - 1, axis=1)[:, :k]
        of_cells, of_rows = (np.argsort(np.argsort(-x, axis=1, kind="stable"), axis=1, kind="stable") for x in (sample[asked] @ self.centres.T, rough))
        self.probes = int(np.quantile(np.take_along_axis(of_cells, cell[true], axis=1), SHARE, method="higher")) + 1
        self.refine = -(-(int(np.quantile(np.take_along_axis(of_rows, true, axis=1), SHARE, method="higher")) + 1) // k)

    def fit(self, v: np.ndarray) -> np.ndarray:
        """Vectors in the model's dimensions."""
        out = np.zeros((len(v), self.dim))
        out[:, : min(self.dim, v.shape[1])] = v[:, : self.dim]
        return out

    def encoded(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = _nearest(v, self.centres)
        rest = v - self.centres[cell]
        return cell, np.column_stack([_nearest(rest[:, a : a + WIDTH], book) for a, book in zip(range(0, self.dim, WIDTH), self.books, strict=True)]).astype(np.uint8)

    def decoded(self, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
        return self.centres[cell] + np.column_stack([book[code[:, i]] for i, book in enumerate(self.books)])


class VectorIndex:
    """Vectors (vec_id, embedding) in cells at `path`. Null ids and vectors take no part; a zero vector has similarity 0."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def create(self, rows: DataFrame, id_col: str = "vec_id", vec: str = "embedding", cells: int | None = None) -> VectorIndex:
        """cells: by default the root of the number of rows, CELLS at most."""
        delete(self.spark, self.path)
        own = rows.where(F.col(id_col).isNotNull() & F.col(vec).isNotNull()).select(F.col(id_col).alias("vec_id"), F.col(vec).cast("array<double>").alias("v"))
        self.kind = dict(own.dtypes)["vec_id"]
        n = own.count()
        sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow().combine_chunks()
        self.model = Model(_unit(sample.column("v").combine_chunks()) if len(sample) else np.zeros((0, WIDTH)), cells or min(CELLS, max(1, round(n**0.5))))
        sent = self.spark.sparkContext.broadcast(self.model)

        def filed(batches):
            model = sent.value
            for batch in batches:
                for a in range(0, len(batch), ROWS):
                    part = batch.slice(a, ROWS)
                    cell, code = model.encoded(model.fit(_unit(part.column(1))))
                    codes = pa.Array.from_buffers(pa.binary(), len(cell), [None, pa.py_buffer(np.arange(len(cell) + 1, dtype=np.int32) * code.shape[1]), pa.py_buffer(np.ascontiguousarray(code))])
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cell.astype(np.int32)), codes, part.column(1)], names=["vec_id", "cell", "code", "v"])

        out = own.mapInArrow(filed, f"vec_id {self.kind}, cell int, code binary, v array<double>")
        out.hint("rebalance", F.col("cell")).sortWithinPartitions("cell", "vec_id").write.partitionBy("cell").parquet(self.path)
        sent.unpersist()
        return self

    def read(self) -> DataFrame:
        return self.spark.read.schema(f"vec_id {self.kind}, code binary, v array<double>, cell int").parquet(self.path)

    def search(self, queries: DataFrame, k: int = 10, query_id: str = "vec_id", vec: str = "embedding", probes: int | None = None, refine: int | None = None, exact: bool = False) -> DataFrame:
        """query_id, vec_id, score, rank: the k rows of the highest cosine similarity among those that are compared exactly; a
        query's own id is left out. probes and refine are the model's own by default; in a collection of very many times the sample's
        rows a true neighbour has more rows before it by code, so that refine should be raised and recall() measured. Starts jobs when called: queries are read in pieces of PIECE_BYTES."""
        if exact:
            return dense_topk(self.read().select("vec_id", F.col("v").alias(vec)), queries, k, vec=vec, query_id=query_id)
        work = Workspace(self.spark)
        asked = queries.where(F.col(query_id).isNotNull() & F.col(vec).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(vec).cast("array<double>").alias("q"))
        kind, most, found = dict(asked.dtypes)["query_id"], k * (refine or self.model.refine), None
        n = asked.count()
        pieces = max(1, -(-n * self.model.dim * 8 // PIECE_BYTES), -(-n * (most + 1) // PIECE_ROWS))
        for i in range(pieces):
            own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(pieces)) == i).toArrow().combine_chunks()
            if not len(own):
                continue
            q = self.model.fit(_unit(own.column("q").combine_chunks()))
            p = min(probes or self.model.probes, len(self.model.centres))
            cells = np.concatenate([np.argpartition(-(q[a : a + ROWS] @ self.model.centres.T), p - 1, axis=1)[:, :p] for a in range(0, len(q), ROWS)])
            order = np.argsort(cells.ravel(), kind="stable")
            sent = self.spark.sparkContext.broadcast((self.model, own.column("query_id").combine_chunks(), q, order // p, np.searchsorted(cells.ravel()[order], np.arange(len(self.model.centres) + 1))))

            def near(batches, sent=sent):
                """(vec_id, code, cell) -> the task's best of each query that probes the cells."""
                model, ids, q, holders, cuts = sent.value
                best = Best(len(ids), most + 1)  # one for the query's own row
                for batch in batches:
                    cell = batch.column(2).to_numpy()
                    code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(batch), -1)
                    for c in np.unique(cell):
                        at = np.flatnonzero(cell == c)
                        for b in range(0, len(at), ROWS):
                            rows = at[b : b + ROWS]
                            here, take = holders[cuts[c] : cuts[c + 1]], pa.array(rows)
                            decoded = model.decoded(cell[rows], code[rows]).T
                            for d in range(0, len(here), BLOCK):
                                best.offer(here[d : d + BLOCK], [batch.column(0).take(take), batch.column(2).take(take)], q[here[d : d + BLOCK]] @ decoded)
                yield from best.batches(ids, ["query_id", "near", "vec_id", "cell"])

            probed = np.unique(cells).tolist()
            rows = self.read().where(F.col("cell").isin(*probed)).select("vec_id", "code", "cell")
            hits = rows.mapInArrow(near, f"query_id {kind}, near double, vec_id {self.kind}, cell int").select("query_id", "vec_id", "cell", "near").where("query_id <> vec_id")
            found = hits if found is None else found.union(hits)
        if found is None:
            return ranked(asked.join(self.read().limit(0), F.lit(True)).select("query_id", "vec_id", F.lit(0.0).alias("score")), k, id_col="vec_id")
        some = work.keep(ranked(found, most, id_col="vec_id", score="near").select("query_id", "vec_id", "cell"))
        size = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
        dot = F.aggregate(F.zip_with("q", "v", lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
        both = some.join(asked, "query_id").join(self.read().select("vec_id", "cell", "v"), ["vec_id", "cell"])
        score = F.when(size("q") * size("v") == 0, F.lit(0.0)).otherwise(dot / (size("q") * size("v")))
        return ranked(both.select("query_id", "vec_id", F.round(score, 6).alias("score")), k, id_col="vec_id")


def recall(found: DataFrame, truth: DataFrame, by: str = "query_id", id_col: str = "vec_id") -> DataFrame:
    """queries, wanted, found, recall: the share of the true rows that are among the found ones."""
    hits = truth.select(by, id_col).join(found.select(by, id_col, F.lit(1).alias("hit")), [by, id_col], "left")
    return hits.agg(F.countDistinct(by).alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("found"), (F.count("hit") / F.count("*")).alias("recall"))

"""Exact top-k inner products by a uniform threshold in three phases.

Each vector is cut into slices of its dimensions; a query's products with the rows, slice by slice, are the lists whose entries
add up to its scores.

1. Each list gives its k best entries. Only these entries are added up, and a query's k-th best among them bounds its k-th
   best score from below: the cutoff, which is broadcast.
2. A score of at least the cutoff has a list with at least cutoff/slices. Entries with such a list are collected; a slice
   whose norms cannot reach it is not even multiplied.
3. What was collected is added up exactly, and the k best remain.

Queries are broadcast in pieces of bounded size and meet the rows where these are; rows are never shuffled, and a run of
rows gives at most k entries a query (slices * k in the first phase) to the next step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrowdoc.llm.common import Scratch

SLICES = 4
#: Queries of a piece, its bytes at most, and queries and rows that are multiplied at once.
PIECE, PIECE_BYTES, QUERY_RUN, ROW_RUN = 8192, 32 << 20, 256, 4096
HITS = "qrow long, row long, vec_id {kind}, score long"


def scaled(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): floor(256 * x) of each component; without ids or components that are null or not finite."""
    usable = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).alias("vec_id"), F.transform(vec_col, lambda x: F.floor(256 * x.cast("double"))).alias("v"))


def matrix(lists) -> np.ndarray:
    """Rows of a list column; short ones are filled up with zeros."""
    sizes = np.asarray(lists.value_lengths())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def sliced(q: np.ndarray, c: np.ndarray, slices: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The slices of both; as floats where no sum can pass 2**53, so that products are exact, else as Python integers."""
    dim = min(q.shape[1], c.shape[1])
    q, c = q[:, :dim], c[:, :dim]
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0)) * max(dim, 1)
    kind = np.float64 if most < 2**53 else object
    return [(q[:, at].astype(kind), c[:, at].astype(kind)) for at in np.array_split(np.arange(dim), slices)]


def best_of_lists(lists: list[np.ndarray], own: np.ndarray, k: int) -> np.ndarray:
    """Phase 1: marks each list's k best entries of every query; own marks a query's own row."""
    some = np.zeros(own.shape, bool)
    for p in lists:
        p = np.where(own, -np.inf, p.astype(np.float64))
        best = np.argpartition(-p, min(k, p.shape[1]) - 1, axis=1)[:, :k]
        some[np.arange(len(p))[:, None], best] = True
    return some & ~own


def collected(parts: list[tuple[np.ndarray, np.ndarray]], cut: np.ndarray) -> np.ndarray:
    """Phase 2: marks the entries with a list that reaches cut/slices."""
    some = np.zeros((len(cut), len(parts[0][1])), bool)
    for q, c in parts:
        norm = [np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) for x in (q, c)]
        # a little slack, as norms are rounded
        able = norm[0] * norm[1].max(initial=0) * len(parts) >= cut - 1e-6 * np.abs(cut) - 1
        if able.any():
            some[able] |= (q[able] @ c.T) * len(parts) >= cut[able, None]
    return some


def added_up(parts: list[tuple[np.ndarray, np.ndarray]], qi: np.ndarray, ci: np.ndarray) -> np.ndarray:
    """Phase 3: the scores of the entries (qi, ci) alone."""
    out = np.zeros(len(qi), parts[0][0].dtype)
    for at in range(0, len(qi), 1 << 16):
        for q, c in parts:
            out[at : at + (1 << 16)] += (q[qi[at : at + (1 << 16)]] * c[ci[at : at + (1 << 16)]]).sum(axis=1)
    return out


def below(score: np.ndarray) -> np.ndarray:
    """Whole numbers as floats that are not larger."""
    out = score.astype(np.float64)
    return np.where(np.abs(out) < 2**53, out, np.nextafter(out, -np.inf))


def ranked(qi: np.ndarray, place: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indices of each query's k best, ties to the smaller place."""
    order = np.lexsort((place, -score.astype(np.float64), qi))
    of = qi[order]
    return order[np.arange(len(of)) - np.searchsorted(of, of) < k]


def _phase(queries, k: int, slices: int, resolve: bool):
    """queries: broadcast (rows, vectors, cutoffs) of a piece."""

    def run(batches):
        qrow, qdata, cut = queries.value
        for batch in batches:
            for at in range(0, len(batch), ROW_RUN):
                part = batch.slice(at, ROW_RUN)
                row, ids, c = part.column(0).to_numpy(), part.column(1), matrix(part.column(2))
                place = np.empty(len(ids), np.int64)
                place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
                for a in range(0, len(qrow), QUERY_RUN):
                    own = qrow[a : a + QUERY_RUN, None] == row[None, :]
                    both = sliced(qdata[a : a + QUERY_RUN], c, slices)
                    if resolve:
                        some = collected(both, cut[a : a + QUERY_RUN]) & ~own
                    else:
                        some = best_of_lists([q @ x.T for q, x in both], own, k)
                    qi, ci = np.nonzero(some)
                    score = added_up(both, qi, ci)
                    if resolve:
                        enough = score >= cut[a + qi]
                        qi, ci, score = qi[enough], ci[enough], score[enough]
                    score = np.clip(score, -(2**63) + 1024, 2**63 - 1024)
                    keep = ranked(qi, place[ci], score, k)
                    columns = [pa.array(qrow[a + qi[keep]]), pa.array(row[ci[keep]]), ids.take(pa.array(ci[keep])), pa.array(score[keep].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["qrow", "row", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, slices: int = SLICES, piece: int = PIECE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of floor(256 * x) for each query.

    vectors: a table with an id and an array of numbers; is_query: a condition on its id. Every row but the query's own
    is a candidate; ties go to the smaller id. Rows with a null id, a null vector, or null or non-finite components take no
    part. Rows with the same id stay different rows: each is a candidate of the other, and each that is a query has its own k
    results under that id. Vectors of different length are compared over what both have. A query with fewer than k candidates
    gets them all. Scores beyond 64 bits are cut to them. Other columns are not read. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    scratch, context = Scratch(spark), spark.sparkContext
    rows = scratch.keep(scaled(vectors, id_col, vec_col).withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "v"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    queries = rows.where(is_query(F.col("vec_id")))
    m, dim = queries.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    pieces = max(1, -(-m // piece), -(-m * dim * 8 // PIECE_BYTES))
    by_query = Window.partitionBy("qrow").orderBy(F.desc("score"), "vec_id", "row")

    def best(hits: DataFrame) -> DataFrame:
        return hits.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)

    out = []
    for i in range(pieces):
        asked = queries.where(F.pmod(F.xxhash64("row"), F.lit(pieces)) == i).select("row", "v").toArrow().combine_chunks()  # of bounded size
        qrow, qdata = asked.column("row").to_numpy(), matrix(asked.column("v").combine_chunks()) if len(asked) else np.zeros((0, 0), np.int64)
        first = best(rows.mapInArrow(_phase(context.broadcast((qrow, qdata, None)), k, slices, False), HITS.format(kind=kind)))
        cutoffs = first.groupBy("qrow").agg(F.count("*").alias("c"), F.min("score").alias("s")).where(F.col("c") == k).select("qrow", "s").toArrow()
        cut = np.full(len(qrow), -np.inf)
        if len(cutoffs):
            order = np.argsort(qrow)
            cut[order[np.searchsorted(qrow[order], cutoffs.column("qrow").to_numpy())]] = below(cutoffs.column("s").to_numpy())
        found = best(rows.mapInArrow(_phase(context.broadcast((qrow, qdata, cut)), k, slices, True), HITS.format(kind=kind)))
        out.append(found if pieces == 1 else scratch.keep(found))
    every = out[0]
    for found in out[1:]:
        every = every.union(found)
    return every.join(queries.select(F.col("row").alias("qrow"), F.col("vec_id").alias("query_id")), "qrow").select("query_id", "rank", "vec_id", "score")

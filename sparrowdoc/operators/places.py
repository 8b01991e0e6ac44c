"""Places of rows in a whole table's order, without a task that sees all of them; rows over all cores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, about, and ranges at most; rows that are looked at to cut one range.
RANGE_ROWS, RANGES, LOOKED_AT = 200_000, 4096, 16


def spread(rows: DataFrame) -> DataFrame:
    """rows over as many partitions as the session has cores, where a small table comes in fewer; others as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _at_most(cuts: list, value: Column, kind) -> Column:
    """How many of the sorted cuts are at most a value: first among every 64th, then among the 64 after that one."""
    literal = lambda some: F.array(*(F.lit(v).cast(kind) for v in some)) if some else F.array().cast(f"array<{kind.simpleString()}>")
    coarse = F.size(F.filter(literal(cuts[::64]), lambda c: c <= value))
    inner = F.array(literal([]), *(literal(cuts[i : i + 64]) for i in range(0, len(cuts), 64)))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * 64 + F.size(F.filter(F.get(inner, coarse), lambda c: c <= value)))


def placed(rows: DataFrame, order: list[str], place: str, total: str | None = None) -> DataFrame:
    """rows with their place (long, from 0) in the order of some columns, and with the number of all rows.

    The table is cut into ranges of the first column by values that rows chosen by a hash have; a range's rows are
    numbered among themselves, and the counts of the ranges before are added. Cuts are fixed values, so that every part of the
    plan sees the same ranges. Nulls come first. Ties share a range; a value that most rows have makes a large one.
    """
    first, kind = F.col(order[0]), rows.schema[order[0]].dataType
    n = rows.count()
    ranges = min(RANGES, n // RANGE_ROWS)
    cuts: list = []
    if ranges > 1:
        every = max(1, n // (ranges * LOOKED_AT))
        looked = rows.select(first.alias("v")).where(first.isNotNull() & (F.pmod(F.xxhash64(first), F.lit(every)) == 0)).distinct().orderBy("v").limit(4 * ranges * LOOKED_AT).toArrow().column("v").to_pylist()
        cuts = looked[:: max(1, -(-len(looked) // ranges))]
    if not cuts:
        own, start, at = rows.withColumn("__range", F.lit(0)), F.lit(0), n
    else:
        own, before, at = rows.withColumn("__range", F.when(first.isNull(), -1).otherwise(_at_most(cuts, first, kind))), [], 0
        for r in own.groupBy("__range").agg(F.count("*").alias("c")).orderBy("__range").collect():  # a row for each range
            before += [F.lit(r["__range"]), F.lit(at)]
            at += r.c
        start = F.element_at(F.create_map(*before), F.col("__range"))
    number = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    out = own.withColumn(place, (number + start).cast("long"))
    return (out.withColumn(total, F.lit(at).cast("long")) if total else out).drop("__range")


def zipped(items: DataFrame, rows: DataFrame, order: list[str], rows_order: list[str] | None = None) -> DataFrame:
    """The i-th of items beside the i-th of rows, each in its own order; an error if their numbers differ."""
    a, b = items.count(), rows.count()
    if a != b:
        raise ValueError(f"{a} items and {b} rows")
    left, right = placed(items, order, "__i"), placed(rows, rows_order or order, "__i")
    return left.join(right, "__i").drop("__i")

"""Results of single items that survive a run that breaks off: a queue of files, a stream over it, a folder for each flush."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowdoc.sources.shared import delete, exists


class ItemSink:
    """Results (key, error, and what else the work gives) of named runs, at `path`.

    A run writes its items as a queue of `flushes` files and works them off as a stream, a file at a time. What a file gives is
    written to a folder named after the stream's batch, in the place of what is there: a batch that is repeated after a failure
    is written once. A run called again by its name goes on where it was; a new run takes up the items that have no result
    without an error.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, error: str = "error"):
        self.spark, self.path, self.key, self.error = spark, path.rstrip("/"), key, error

    def results(self) -> DataFrame | None:
        """All results, with their run; None before the first."""
        out = f"{self.path}/results"
        return self.spark.read.option("basePath", out).parquet(out).drop("flush").withColumn("run", F.col("run").cast("string")) if exists(self.spark, out) else None

    def todo(self, items: DataFrame) -> DataFrame:
        """Items without a result that has no error."""
        done = self.results()
        return items if done is None else items.join(done.where(F.col(self.error).isNull()).select(self.key), self.key, "left_anti")

    def best(self) -> DataFrame:
        """One result for each key: of those without an error, or else of all, the one of the last run by name."""
        done = self.results()
        order = F.struct(F.col(self.error).isNull(), F.col("run"))
        return done.groupBy(self.key).agg(F.max_by(F.struct(*(c for c in done.columns if c != self.key)), order).alias("r")).select(self.key, "r.*")

    def run(self, name: str, items: DataFrame, work: Callable[[DataFrame], DataFrame], flushes: int = 8) -> DataFrame:
        """Works off the run and returns all results. What `work` raises ends the run; what was flushed stays."""
        queue = f"{self.path}/queue/{name}"
        if not exists(self.spark, f"{queue}/_SUCCESS"):
            delete(self.spark, queue)
            self.todo(items).repartition(flushes, self.key).write.parquet(queue)
        stream = self.spark.readStream.schema(self.spark.read.parquet(queue).schema).option("maxFilesPerTrigger", 1).parquet(queue)

        def flush(batch: DataFrame, number: int) -> None:
            work(batch).write.mode("overwrite").parquet(f"{self.path}/results/run={name}/flush={number}")

        started = stream.writeStream.foreachBatch(flush).option("checkpointLocation", f"{self.path}/progress/{name}").trigger(availableNow=True).start()
        try:
            started.awaitTermination()
        finally:
            started.stop()
        return self.results()

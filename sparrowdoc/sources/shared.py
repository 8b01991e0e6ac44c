"""Folders that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; without the setting a local session gets a temporary one, and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        had = spark.sparkContext._jsc.sc().getCheckpointDir()
        if had.isDefined():
            return had.get()
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sparrowdoc-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found


def delete(spark: SparkSession, path: str) -> None:
    """Removes a file or folder of any file system; one that isn't there is no error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


class Workspace:
    """A folder of its own in the shared one, for tables that an operator writes on the way; it goes when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.count = spark, f"{shared_dir(spark).rstrip('/')}/work-{uuid.uuid4().hex}", 0
        atexit.register(self._end)

    def path(self, name: str | None = None) -> str:
        self.count += 1
        return f"{self.root}/{name or self.count}"

    def keep(self, df: DataFrame) -> DataFrame:
        """df as a written table: its lineage is cut, and it is not computed again."""
        path = self.path()
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _end(self) -> None:
        try:
            if self.count and not self.spark.sparkContext._jsc.sc().isStopped():
                delete(self.spark, self.root)
        except Exception:  # the gateway may end before Python does; the folder's owner clears it then
            pass

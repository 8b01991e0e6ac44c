"""op9: repeated passages of every document."""

from pyspark.sql import DataFrame, SparkSession

from sparrowdoc.llm.suffix import find_repeats


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))

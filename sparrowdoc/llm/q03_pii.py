"""op3: personal data in every document."""

from pyspark.sql import DataFrame, SparkSession

from sparrowdoc.llm.pii import find_pii


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))

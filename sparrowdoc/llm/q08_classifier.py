"""op8: the quality of every document."""

from pyspark.sql import DataFrame, SparkSession

from sparrowdoc.llm.classifier import classify


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

"""op7: language-model scores of every document."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowdoc.llm.lm import score_texts


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mean_score (a token) compares texts of any length."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("mean_score", F.col("score") / F.col("n_tokens"))

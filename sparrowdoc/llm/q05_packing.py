"""op5: all documents in sequences of at most 4096 tokens."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparrowdoc.llm.packing import pack


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))

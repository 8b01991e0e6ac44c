"""op10: every document encoded to byte-level BPE and decoded."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparrowdoc.llm.byte_bpe import round_trips


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trips(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

"""A corpus from raw documents: quality, near copies, repeated passages, personal data, packed sequences.

STAGES are (name, function); each function takes (spark, docs, sf_dir), works on all that the stage before kept, and
returns a DataFrame. All but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparrowdoc.llm.classifier import accepted
from sparrowdoc.llm.common import Scratch
from sparrowdoc.llm.minhash import deduplicated
from sparrowdoc.llm.packing import pack
from sparrowdoc.llm.pii import redacted
from sparrowdoc.llm.suffix import without_repeats

#: Parts of texts that a worker remembers in the last stage, when the JVM beside it has the heap that the stages before took.
REMEMBERED = 100_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on `labels` outside the hold-out fold, accepts."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one of the smallest doc_id."""
    return deduplicated(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 400 bytes that occur elsewhere; n_chars as before counts the original text."""
    return without_repeats(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return redacted(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), memory=REMEMBERED)


STAGES = [("quality", quality), ("near_copies", near_copies), ("passages", passages), ("personal_data", personal_data), ("sequences", sequences)]

#: SQL can't express a trained classifier or a tokenizer; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written, so that the next one reads a table."""
    scratch, out = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if i + 1 < len(STAGES):
            out = scratch.keep(out)
    return out

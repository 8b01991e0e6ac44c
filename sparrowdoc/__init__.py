"""Spark-first analytics for document corpora: intake, retrieval, evaluation and statistics."""

__version__ = "0.1.0"

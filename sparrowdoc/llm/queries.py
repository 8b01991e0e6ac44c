"""Queries of the corpus operators: each applies its operator to its whole table and returns the contracted digest."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Name of a query and its module in this package.
MODULES = {
    "op1_minhash_near_dedup": "q01_near_dedup",
    "op2_chat_formatting": "q02_chat",
    "op3_pii": "q03_pii",
    "op4_exact_topk": "q04_topk",
    "op5_packing": "q05_packing",
    "op6_quality_rules": "q06_rules",
    "op7_lm_scoring": "q07_lm",
    "op8_quality_classifier": "q08_classifier",
    "op9_suffix_array_dedup": "q09_suffix",
    "op10_byte_bpe": "q10_byte_bpe",
    "op11_license_scans": "q11_licenses",
    "op12_periodic_runs": "q12_periodic",
    "op13_phrase_collocations": "q13_collocations",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: importlib.import_module(f"sparrowdoc.llm.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"sparrowdoc.llm.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}

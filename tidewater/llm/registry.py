"""Queries and oracle SQL of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Module of each query.
MODULES = {
    "op1_simhash_near_dedup": "simhash",
    "op2_warc": "warc",
    "op3_toxicity": "toxicity",
    "op4_mix_sources": "mixing",
    "op5_quality_rules": "quality_rules",
    "op6_quality_classifier": "gam",
    "op7_url_filter": "url_filter",
    "op8_byte_level_bpe": "bpe",
    "op9_lattice_lm": "lattice_lm",
    "op10_exact_top_k": "topk",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}

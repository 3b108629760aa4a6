"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query: module that holds the function of that name.
MODULES = {
    "op1_toxicity": "toxicity",
    "op2_shards": "shards",
    "op3_mixing": "mixing",
    "op4_rules": "rules",
    "op5_packing": "packing",
    "op6_vectors": "vectors",
    "op7_urls": "urls",
    "op8_jaccard": "jaccard",
    "op9_warc": "warc",
    "op10_store": "store",
    "op11_exact": "exactfit",
    "op12_resampling": "resampling",
    "op13_search": "search",
}

#: Query: module and constant that hold its DuckDB SQL.
SQL = {
    "op9_warc": ("warc", "OP9_SQL"),
    "op12_resampling": ("resampling", "OP12_SQL"),
    "op13_search": ("search", "OP13_SQL"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"{__package__}.{module}"), constant) for name, (module, constant) in SQL.items()}

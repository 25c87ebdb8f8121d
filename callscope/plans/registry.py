"""All registered queries of the run operators and their oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship

MODULES = ["trace_queries", "table_queries", "contract_queries", "rule_queries", "value_queries", "package_queries", "schema_queries"]


def _modules():
    return [importlib.import_module(f"{__package__}.{m}") for m in MODULES]


def _shipped(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(f) for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLES.items()}

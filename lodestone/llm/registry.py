"""Queries of the operators of this subpackage, by name, and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Modules with ``QUERIES`` and ``ORACLES``.
MODULES = ("lodestone.llm.queries",)


def _ready(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, after Python workers have been told where this package lies (a session started elsewhere may not know)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries by name."""
    return {k: _ready(v) for name in MODULES for k, v in importlib.import_module(name).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """The SQL of those queries that SQL can express."""
    return {k: v for name in MODULES for k, v in importlib.import_module(name).ORACLES.items()}

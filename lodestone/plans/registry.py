"""Query registry: each entry pairs a Spark plan with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules whose ``QUERIES`` (name -> function) and ``ORACLES`` (name -> SQL) make up the registry.
MODULES: tuple[str, ...] = ("lodestone.plans.scalars", "lodestone.plans.relations", "lodestone.plans.search", "lodestone.plans.content", "lodestone.plans.monitoring", "lodestone.plans.intake", "lodestone.plans.corpus", "lodestone.plans.project", "lodestone.plans.lifecycle", "lodestone.plans.code", "lodestone.plans.writes", "lodestone.plans.tools")

#: Name of the query that ``entry`` runs.
FLAGSHIP = "search_keyword"


def _gather(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        for key, value in getattr(importlib.import_module(name), attribute).items():
            if key in found:
                raise ValueError(f"two queries are named {key}")
            found[key] = value
    return found


def queries() -> dict[str, Query]:
    """All queries by name."""
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    """The SQL of those queries that SQL can express."""
    return _gather("ORACLES")

"""All queries of the statistics operators, collected from the modules of this package."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules with a QUERIES dict (name -> callable) and an ORACLES dict (name -> SQL).
MODULES: tuple[str, ...] = ("descriptive", "tests", "transforms", "distributions", "spatial", "streams")


def _modules():
    return [importlib.import_module(f"quillon.plans.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to callable."""
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    return {k: v for m in _modules() for k, v in m.ORACLES.items()}

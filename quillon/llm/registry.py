"""The queries of this package and their DuckDB SQL."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Modules opN, each with one query function named opN_<name> and, where SQL can express it, SQL.
_NAMES = sorted((p.stem for p in Path(__file__).parent.glob("op*.py") if re.fullmatch(r"op\d+", p.stem)), key=lambda x: int(x[2:]))


def _each():
    for name in _NAMES:
        module = importlib.import_module(f"quillon.llm.{name}")
        yield next(k for k in vars(module) if k.startswith(f"{name}_")), module


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to callable."""
    return {k: getattr(m, k) for k, m in _each()}


def oracle_sql() -> dict[str, str]:
    """Query name to SQL."""
    return {k: m.SQL for k, m in _each() if getattr(m, "SQL", None)}

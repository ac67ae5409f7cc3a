"""All queries of the core library and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with ``QUERIES`` (name -> function of session and directory) and ``SQL`` (name -> statement).
MODULES: tuple[str, ...] = tuple(f"loreweave.operators.{m}" for m in ("search", "audit", "links", "code", "graph", "vectors", "semantic", "journal", "roadmap", "merges", "journal_text", "selection", "reports", "index", "evaluate", "events"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {}
    for name in MODULES:
        found |= import_module(name).QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for name in MODULES:
        found |= import_module(name).SQL
    return found

"""Key → query and key → DuckDB SQL of the engine's own operators.

The modules named in MODULES register their queries here when they are first imported.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
MODULES = ("text", "chunks", "layout", "retrieval", "joins", "evaluation", "answers", "uncertainty", "sessions")


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir) under ``key``, with its SQL if SQL can express it."""

    def add(function: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = function
        if sql is not None:
            ORACLE_SQL[key] = sql
        return function

    return add


def load() -> None:
    for name in MODULES:
        import_module(f"corvane.plans.{name}")

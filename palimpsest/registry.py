"""Named queries over the star tables, each with the SQL that says the same."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("temporal", "log", "relational", "graph", "reads", "projection", "writes", "resolution", "rules", "telemetry", "text", "scalars", "knowledge", "attribution", "ledger", "evaluation", "connectors", "streams")
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its oracle if SQL can say it."""

    def add(f: Query) -> Query:
        if f.__name__ in _queries:
            raise ValueError(f"two queries are named {f.__name__}")
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql.strip()
        return f

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries and their oracles."""
    for name in MODULES:
        importlib.import_module(f"palimpsest.queries.{name}")
    return dict(_queries), dict(_oracles)

"""The registered queries, each with the SQL that checks it where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorgauge.plans.views import Tables, duckdb_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``build(tables)`` under a name."""

    def keep(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(spark, folder))

        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = duckdb_sql(oracle)
        return build

    return keep


def r(column: str | Column, name: str | None = None, digits: int = 6) -> Column:
    """Rounded double under its own or a new name."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.round(c.cast("double"), digits)
    label = name or (column if isinstance(column, str) else None)
    return out.alias(label) if label else out


def load_all() -> None:
    """Import the modules that register queries."""
    for part in ("sources", "columns", "groups", "metrics", "stats", "jobs"):
        import_module(f"tutorgauge.plans.queries_{part}")

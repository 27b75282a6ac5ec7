"""All queries over the reference tables, and the SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "j01_line_cer"


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) as a query, with its SQL."""

    def add(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def load() -> None:
    """Imports the modules that register queries."""
    from quirekit.plans import decoding, documents, evaluation, layout, scoring  # noqa: F401


load()

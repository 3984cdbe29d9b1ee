"""Named queries over the driver's tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str | Callable[[], str]] = {}


def oracle_of(name: str) -> str:
    """The SQL of a query, for queries that build on it."""
    sql = _ORACLES[name]
    return sql if isinstance(sql, str) else sql()


def query(sql: str | Callable[[], str] | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL where SQL can say it."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def _load() -> None:
    from . import aggregate_plans, evaluation_plans, join_plans, lifecycle_plans, more_plans, retrieval_plans, scope_plans, scoring_plans, state_plans, structure_plans, text_plans, version_plans  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: oracle_of(name) for name in _ORACLES}

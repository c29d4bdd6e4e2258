"""Queries of the engine's operators and the DuckDB SQL of each."""

from __future__ import annotations

from collections.abc import Callable

FLAGSHIP = "doc_markdown"

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) -> DataFrame under a name, with its SQL."""

    def add(f: Callable) -> Callable:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def sql(name: str) -> str:
    """The SQL of a query registered before."""
    return _SQL[name]


def queries() -> dict[str, Callable]:
    from quire.plans import catalog  # noqa: F401  registers

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from quire.plans import catalog  # noqa: F401

    return dict(_SQL)

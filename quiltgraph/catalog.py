"""Registered queries of the graph engine with their DuckDB equivalents."""

from __future__ import annotations

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def register(name: str, fn, sql: str | None = None) -> None:
    _QUERIES[name] = fn
    if sql is not None:
        _SQL[name] = sql


def _load() -> None:
    """Registration happens on import of the plan modules."""
    from .plans import analyses, frameworks, graphs, kinds, library, maintenance, questions, ranking, relational, retrieval, sessions  # noqa: F401


def queries() -> dict:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL

"""All registered queries of the library with their SQL."""

from __future__ import annotations

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame."""

    def put(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return put


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _load() -> None:
    from . import audit_queries, bookkeeping_queries, excerpt_queries, graph_queries, learning_queries, lexical_queries, review_queries, store_queries, text_queries, vector_queries  # noqa: F401


_load()

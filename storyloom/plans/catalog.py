"""Registry of the library's own queries and their DuckDB equivalents."""

from __future__ import annotations

from . import entity_queries, graph_queries, retrieval_queries, state_queries, text_queries  # noqa: F401  they register themselves
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

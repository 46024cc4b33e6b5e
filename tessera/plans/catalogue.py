"""All queries of the library outside the subpackage for language models, and their SQL."""

from __future__ import annotations

from . import conversation_queries, nested_queries, roundtrip_queries, selection_queries, task_queries, text_queries
from .registry import QUERIES, SQL, Query

__all__ = ["conversation_queries", "nested_queries", "oracle_sql", "queries", "roundtrip_queries", "selection_queries", "task_queries", "text_queries"]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""Named queries and their SQL."""

from __future__ import annotations


def all_queries() -> tuple[dict, dict]:
    """Queries and SQL by name."""
    from . import changes, compression, stores, text, vectors  # noqa: F401
    from .registry import ORACLE_SQL, QUERIES

    return QUERIES, ORACLE_SQL

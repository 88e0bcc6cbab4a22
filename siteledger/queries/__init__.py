"""Registered queries over the star-schema tables, with SQL that states the same result."""

from . import documents_and_readers, functions, layouts, masters, reports  # noqa: F401
from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]

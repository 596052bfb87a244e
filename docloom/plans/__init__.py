"""Registered queries over the driver's tables, and their SQL."""

from docloom.plans import table_queries, text_queries  # noqa: F401
from docloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

"""Compositions of operators, and the registered queries with their SQL."""

from . import catalog_queries, graph_queries, retrieval_queries  # noqa: F401  they register their queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

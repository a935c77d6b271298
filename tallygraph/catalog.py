"""All queries of the transaction-graph part, with their DuckDB counterparts."""

from __future__ import annotations

from .plans import file_oracle, file_queries, oracle, queries
from .plans.queries import flagship

QUERIES = queries.QUERIES | file_queries.QUERIES
ORACLE = oracle.ORACLE | file_oracle.ORACLE

__all__ = ["ORACLE", "QUERIES", "flagship"]

"""All registered queries and their SQL."""

from __future__ import annotations

from memlake.plans import more_queries, search_queries, store_queries

QUERIES = search_queries.QUERIES | store_queries.QUERIES | more_queries.QUERIES
ORACLE_SQL = search_queries.ORACLE_SQL | store_queries.ORACLE_SQL | more_queries.ORACLE_SQL

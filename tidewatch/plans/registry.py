"""All registered queries of the engine, and their SQL."""

from __future__ import annotations

from . import join_queries, oracle, queries

QUERIES = queries.QUERIES | join_queries.QUERIES
ORACLE = oracle.ORACLE | join_queries.ORACLE

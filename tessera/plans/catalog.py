"""The registered queries and their SQL."""

from __future__ import annotations

from . import calendar_queries, coverage_queries, match_queries, near_queries, nearest_queries, source_queries, sql_queries

FLAGSHIP = "remaining_menu"


def queries():
    return sql_queries.queries() | calendar_queries.QUERIES | coverage_queries.QUERIES | nearest_queries.QUERIES | near_queries.QUERIES | match_queries.QUERIES | source_queries.QUERIES


def oracle_sql():
    return sql_queries.oracle_sql() | calendar_queries.ORACLES | coverage_queries.ORACLES | nearest_queries.ORACLES | match_queries.ORACLES | source_queries.ORACLES

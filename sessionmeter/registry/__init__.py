"""Queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable


def all_queries() -> dict[str, Callable]:
    from sessionmeter.registry import file_queries, log_queries, stored_queries, stream_queries, usage_queries

    return {**usage_queries.QUERIES, **log_queries.QUERIES, **file_queries.QUERIES, **stream_queries.QUERIES, **stored_queries.QUERIES}


def all_oracles() -> dict[str, str]:
    from sessionmeter.registry import file_sql, log_sql, stored_sql, stream_sql, usage_sql

    return {**usage_sql.ORACLE, **log_sql.ORACLE, **file_sql.ORACLE, **stream_sql.ORACLE, **stored_sql.ORACLE}

"""Registered queries of the genetics operators, each beside its SQL.

Names are ``<id of the operator in the survey>_<what it is>``. A query without SQL here is one that SQL can't express.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from . import ancestry, cohort, files, lookups, population, reports, text  # noqa: F401  each adds its own

    return QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return ORACLES

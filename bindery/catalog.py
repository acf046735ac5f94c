"""The registry of queries and of the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bindery.plans import relational_queries, scalar_queries, source_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return scalar_queries.queries() | relational_queries.queries() | source_queries.queries()


def oracle_sql() -> dict[str, str]:
    return scalar_queries.ORACLE | relational_queries.ORACLE | source_queries.ORACLE

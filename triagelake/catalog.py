"""The catalogue of queries over the operators, with the SQL that each is held against.

Names are those of the operator inventory. Of the queries without SQL, README lists those that no test holds against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from triagelake.plans import queries_detail, queries_exchange, queries_metrics, queries_more, queries_sequences, queries_tables, queries_verifier

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (queries_metrics, queries_sequences, queries_tables, queries_more, queries_verifier, queries_detail, queries_exchange)


def queries() -> dict[str, Query]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}

"""The queries of the library and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.plans import arrival_queries, corpus_queries, maintenance_queries, retrieval_queries, text_queries

PARTS = (retrieval_queries, corpus_queries, text_queries, arrival_queries, maintenance_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}

"""All queries of the library by name, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clipfold.plans import batch_queries, composed_queries, history_queries, nested_queries, table_queries, text_queries, web_queries

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = text_queries.QUERIES | table_queries.QUERIES | nested_queries.QUERIES | web_queries.QUERIES | history_queries.QUERIES | batch_queries.QUERIES | composed_queries.QUERIES
ORACLE_SQL: dict[str, str] = text_queries.ORACLE_SQL | table_queries.ORACLE_SQL | nested_queries.ORACLE_SQL | web_queries.ORACLE_SQL | history_queries.ORACLE_SQL | batch_queries.ORACLE_SQL | composed_queries.ORACLE_SQL

flagship = text_queries.dedup_representatives

"""All core queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkfathom.plans import audit_queries, core_queries, filter_queries, probe_queries, text_queries

flagship = text_queries.flagship
_ALL = (audit_queries, core_queries, filter_queries, probe_queries, text_queries)  # each registers its queries on import
Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return dict(core_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(core_queries.SQL)

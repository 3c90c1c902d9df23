"""Registry of panel queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit_queries, evidence_queries, feature_queries, io_queries, inference_queries, pair_queries, portfolio_queries, strategy_queries, study_queries

_PARTS = (feature_queries, portfolio_queries, inference_queries, audit_queries, strategy_queries, study_queries, evidence_queries, pair_queries, io_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for part in _PARTS for name, (fn, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, (_, sql) in part.QUERIES.items() if sql}

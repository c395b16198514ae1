"""The registry of the measurement queries and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from calibron.plans import fit_queries, loading_queries, log_queries, matrix_queries, more_queries, placement_queries, stream_queries, text_queries  # noqa: F401  they register themselves
from calibron.plans.registry import QUERIES, SQL
from calibron.sources.domain import Domain


def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix_queries.leaderboard(Domain(spark, sf_dir)).orderBy("rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""Registration of queries beside their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from calibron.sources.domain import Domain, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``make(domain)`` under ``name``; ``sql`` is the same over the raw and derived tables."""

    def register(make: Callable[[Domain], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: make(Domain(spark, sf_dir))
        if sql is not None:
            SQL[name] = oracle(sql)
        return make

    return register

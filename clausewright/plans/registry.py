"""All core queries by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import answering, corpus, evaluation, history, ingest, retrieval, runs, stores

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (history, retrieval, evaluation, runs, ingest, stores, answering, corpus)


def queries() -> dict[str, Query]:
    """Every query, with the package sent to the Python workers before it runs."""

    def shipped(f: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship(spark)
            return f(spark, sf)

        return run

    return {name: shipped(f) for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}

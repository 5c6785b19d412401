"""The list of queries and of their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query (spark, sf_dir) under its name, with SQL that gives the same rows where there is any."""

    def register(run: Query) -> Query:
        QUERIES[name or run.__name__] = run
        if oracle:
            ORACLES[name or run.__name__] = oracle
        return run

    return register

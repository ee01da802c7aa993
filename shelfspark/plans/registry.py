"""Queries that are registered by name, each with an oracle of its own in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalog
from .catalog import DUCK

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def registered(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with DuckDB SQL over the views if SQL can say it."""

    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if oracle:
            ORACLE[query.__name__] = catalog.render(oracle, DUCK)
        return query

    return add


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return catalog.run(spark, sf_dir, sql)

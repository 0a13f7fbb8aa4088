"""Registered queries and, where SQL can say it, the equivalent statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsweave.plans.views import cte

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, oracle: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register ``fn(spark, sf_dir)``; ``views`` are prepended to the statement as CTEs."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        COVERS[name] = covers
        if oracle is not None:
            ORACLES[name] = cte(views, oracle)
        return fn

    return register

"""Where queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, with_views: bool = True) -> Callable[[Query], Query]:
    """Register a query; ``sql`` continues the common table expressions of the views unless ``with_views`` is off."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise KeyError(f"{name!r} is registered already")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = f"WITH {views.SQL}{sql}" if with_views else sql
        return function

    return add

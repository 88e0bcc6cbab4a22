"""Names, DataFrame functions and checking SQL of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.star_views import StarViews
from .views_sql import with_views

_QUERIES: dict[str, Callable[[StarViews], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the views; view names used in the SQL are expanded."""

    def keep(function: Callable[[StarViews], DataFrame]) -> Callable[[StarViews], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = function
        if sql is not None:
            _SQL[name] = with_views(sql)
        return function

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(function):
        return lambda spark, sf_dir: function(StarViews(spark, sf_dir))

    return {name: bind(function) for name, function in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

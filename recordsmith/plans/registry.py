"""Where queries register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def add(name: str, make: Callable[[Views], DataFrame], sql: str | None = None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(Views(spark, sf_dir))

    query.__name__ = name
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = with_views(sql)

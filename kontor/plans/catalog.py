"""The query catalog: name -> (Spark callable(spark, sf_dir), oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

SparkQuery = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    run: SparkQuery
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, run: SparkQuery, sql: str | None) -> None:
    if name in REGISTRY:
        raise KeyError(name)
    REGISTRY[name] = Query(name, run, sql)

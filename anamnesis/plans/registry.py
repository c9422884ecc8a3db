"""Where queries and their SQL are collected."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import ship

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a query under a name, with SQL for DuckDB where SQL can express it."""

        def add(f: Query) -> Query:
            self.queries[name] = wraps(f)(lambda spark, sf_dir: f(ship(spark), sf_dir))
            if sql:
                self.oracles[name] = sql
            return f

        return add

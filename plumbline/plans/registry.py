"""A registry of named queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of (tables reader) under its name, with DuckDB SQL for the same rows."""

    def add(fn: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        if fn.__name__ in QUERIES:
            raise ValueError(f"two queries are named {fn.__name__}")
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql:
            ORACLES[fn.__name__] = sql
        return run

    return add

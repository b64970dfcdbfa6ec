"""The queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def register(key: str, sql: str | None = None):
    """Register a function ``(spark, folder) -> DataFrame``, with its check in DuckDB SQL where there is one."""

    def keep(fn):
        LLM_QUERIES[key] = fn
        if sql is not None:
            LLM_ORACLES[key] = sql
        return fn

    return keep

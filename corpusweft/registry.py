"""Queries by name, each beside its SQL twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function (spark, sf_dir) under its own name; sql: the same rows in DuckDB's SQL."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shaped(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Rows of a statement in the SQL that Spark and DuckDB share, over tables written as {name}: test tables in an operator's shape."""
    return spark.sql(sql, **{name: table(spark, sf_dir, name) for name in sorted(set(re.findall(r"\{(\w+)\}", sql)))})


def plain(sql: str) -> str:
    """The same statement for DuckDB."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)

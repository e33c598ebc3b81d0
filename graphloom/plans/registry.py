"""The register of queries over the test tables, and of SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a table loader under its name."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def rounded(c: str, name: str | None = None, places: int = 6) -> Column:
    return F.round(F.col(c), places).alias(name or c)

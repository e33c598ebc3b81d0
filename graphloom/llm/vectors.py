"""Checks and shapes of vector columns that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vec: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    return vec.isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def scaled(vec: Column, scale: int) -> Column:
    """floor(scale * x) of each component, in double precision."""
    return F.transform(vec, lambda x: F.floor(x * F.lit(float(scale))))


def shard_count(rows: DataFrame, size: Column, components: int = 1 << 22, least: int = 2048) -> int:
    """Shards of some 4 million components at most, and more of them, down to 2,048 rows each, while cores would stand idle."""
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(size.cast("double")), F.lit(0.0))).first()
    return max(1, int(-(-total // components)), min(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-n // least)))

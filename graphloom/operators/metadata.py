"""What a node's properties say of its age and weight. properties is a map of strings; what is no number counts as absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(properties: Column, name: str) -> Column:
    """A property as a whole number, or null."""
    text = F.trim(F.try_element_at(properties, F.lit(name)))
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))


def authority(properties: Column, default: int = 0) -> Column:
    return F.coalesce(whole(properties, "authority"), F.lit(default))


def year(properties: Column) -> Column:
    return whole(properties, "year")


def version(properties: Column) -> Column:
    return F.coalesce(F.try_element_at(properties, F.lit("version")), F.lit(""))


def is_current(properties: Column, as_of: int) -> Column:
    """Whether the bounds valid_from and valid_to allow the time; without bounds a fact does not age."""
    low, high = whole(properties, "valid_from"), whole(properties, "valid_to")
    return F.coalesce(low <= as_of, F.lit(True)) & F.coalesce(high >= as_of, F.lit(True))


def authority_ranked(nodes: DataFrame, limit: int) -> DataFrame:
    """The most trusted nodes, newer ones first, then by id."""
    return nodes.orderBy(authority(F.col("properties")).desc(), F.col("updated_at").desc(), "id").limit(limit)


def summary(nodes: DataFrame, length: int = 240) -> DataFrame:
    """Rows (id, kind, title, preview, tags, properties): longer contents end in an ellipsis."""
    content = F.coalesce("content", F.lit(""))
    cut = F.when(F.length(content) > length, F.concat(F.substring(content, 1, length), F.lit("…"))).otherwise(content)
    return nodes.select("id", "kind", "title", cut.alias("preview"), "tags", "properties")

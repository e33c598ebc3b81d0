"""Graphs as text: Markdown and JSON lines that Spark writes, long contents set apart, and a report of the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import graph


def markdown_lines(nodes: DataFrame) -> DataFrame:
    """Rows (kind, title, id, line), to be read in that order: a section for each kind, in it a paragraph for each node."""
    tags = F.coalesce(F.array_join("tags", ", "), F.lit(""))
    head = F.concat(F.lit("### "), F.coalesce("title", F.lit("")), F.when(tags != "", F.concat(F.lit(" ["), tags, F.lit("]"))).otherwise(""))
    use = F.format_string("- **Usage**: %d accesses, %d success, %d failure", F.col("access_count"), F.col("success_count"), F.col("failure_count"))
    source = F.when(F.coalesce("source", F.lit("")) != "", F.concat(F.lit("- **Source**: "), "source"))
    body = F.concat_ws("\n", head, F.lit(""), F.format_string("- **Level**: %s", F.col("level").cast("string")), F.format_string("- **Vitality**: %.2f", F.col("vitality")), use, source, F.lit(""), F.coalesce("content", F.lit("")), F.lit(""))
    first = F.row_number().over(Window.partitionBy("kind").orderBy("title", "id")) == 1
    section = F.when(first, F.concat(F.lit("## "), F.initcap("kind"), F.lit("\n\n"))).otherwise("")
    return nodes.select("kind", "title", "id", F.concat(section, body).alias("line")).orderBy("kind", "title", "id")


def json_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (part, line): nodes, and the edges with both ends among them, each as one JSON object."""
    own = ["id", "kind", "title", "content", "tags", "level", "vitality", "access_count", "success_count", "failure_count", "source"]
    n = nodes.select(F.lit("node").alias("part"), F.to_json(F.struct(*[c for c in own if c in nodes.columns])).alias("line"))
    ids = nodes.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return n.union(inside.select(F.lit("edge"), F.to_json(F.struct("source_id", "target_id", "kind", "weight"))))


def offload(nodes: DataFrame, most: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Nodes whose long contents give way to a reference, and rows (id, content) of those contents."""
    long = F.length("content") > most
    blobs = nodes.where(long).select("id", "content")
    return nodes.withColumn("content", F.when(long, F.concat(F.lit("blob://"), "id")).otherwise(F.col("content"))), blobs


def restore(nodes: DataFrame, blobs: DataFrame) -> DataFrame:
    """Nodes with their long contents again."""
    held = blobs.select("id", F.col("content").alias("_long"))
    return nodes.join(held, "id", "left").withColumn("content", F.coalesce("_long", "content")).drop("_long")


def report(nodes: DataFrame, edges: DataFrame, hubs: int = 10) -> str:
    """A short Markdown report of counts and hubs: a few rows of aggregates, put together on the driver."""
    lines = ["# Graph", ""]
    for what, rows in [("Counts", graph.graph_stats(nodes, edges).orderBy("what", "name").collect()), ("Hubs", graph.hubs(edges, limit=hubs).collect())]:
        lines += [f"## {what}", "", *(f"- {' '.join(str(v) for v in r)}" for r in rows), ""]
    return "\n".join(lines)


def context(nodes: DataFrame, categories: DataFrame, tables: dict[str, str]) -> str:
    """What a reader needs to know of a graph: categories, tables, sample values, and columns that look like foreign keys."""
    lines = ["Categories: " + ", ".join(r.category for r in categories.orderBy(F.col("documents").desc(), "category").limit(50).collect())]
    for r in graph.property_samples(nodes).orderBy("table", "property").collect():  # tables times columns
        target = next((t for t, key in sorted(tables.items()) if key == r.property and t != r.table), None)
        guess = f" -> {target}" if target else " (key?)" if r.property.endswith(("_no", "_id", "_code")) else ""
        lines.append(f"{r.table}.{r.property}{guess}: {r.samples}")
    return "\n".join(lines)

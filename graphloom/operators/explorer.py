"""Views of a graph: an overview, what is around nodes, chunks, rows, edges and communities, and figures of the whole.

Every view but the overview takes a table of ids (id) and gives rows that say in `of` which one they belong to, so that
one view of many nodes is one set of joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import graph


@dataclass(frozen=True)
class Overview:
    """Nodes (id, label, kind, tags, size, preview) and the edges between them."""

    nodes: DataFrame
    edges: DataFrame


def ends(edges: DataFrame) -> DataFrame:
    """Rows (of, id, edge, way, weight): each edge as seen from both of its ends."""
    out = edges.select(F.col("source_id").alias("of"), F.col("target_id").alias("id"), F.col("kind").alias("edge"), F.lit("out").alias("way"), "weight")
    return out.union(edges.select("target_id", "source_id", "kind", F.lit("in"), "weight"))


def of_source(nodes: DataFrame, source: str) -> DataFrame:
    """Nodes that come from a source, a document or a table of that name."""
    same = lambda p: F.coalesce(F.try_element_at("properties", F.lit(p)) == source, F.lit(False))
    return nodes.where(F.coalesce(F.col("source") == source, F.lit(False)) | same("parent_doc") | same("_table_name"))


def overview(nodes: DataFrame, edges: DataFrame, root: str | None = None, source: str | None = None, kinds: list[str] | None = None, most: int = 500, depth: int = 3, chunks: bool = False, phrases: bool = False) -> Overview:
    """Part of a graph to look at: without chunks and phrase hubs if not asked for; around a root, the nearest nodes first."""
    shown = nodes if chunks else nodes.where("kind <> 'chunk'")
    shown = shown if phrases else shown.where(~F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), "_phrase"))
    shown = shown.where(F.col("kind").isin(kinds)) if kinds else shown
    shown = of_source(shown, source) if source else shown
    if root is None:
        some = shown.orderBy("id").limit(most)
    else:
        start = nodes.where(F.col("id") == root).select("id")
        near = graph.neighbours(edges, start, depth).union(start.select("id", F.lit(0)))
        some = shown.join(near, "id").orderBy("hop", "id").limit(most).drop("hop")
    inside = some.select("id")
    between = edges.join(inside.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(inside.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    size = ends(edges).groupBy("of").agg(F.count("*").alias("size")).withColumnRenamed("of", "id")
    seen = some.join(size, "id", "left").select("id", F.col("title").alias("label"), "kind", "tags", F.coalesce("size", F.lit(0)).alias("size"), F.substring(F.coalesce("content", F.lit("")), 1, 100).alias("preview"))
    return Overview(seen, between)


def around(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (of, id, kind, title, edge, way, weight) next to the nodes."""
    near = ends(edges).join(ids.select(F.col("id").alias("of")).distinct(), "of", "left_semi")
    return near.join(nodes.select("id", "kind", "title"), "id").select("of", "id", "kind", "title", "edge", "way", "weight")


def entity_context(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (of, part, id, title): the chunks that name an entity, the entities next to it, and its community."""
    near = around(nodes, edges, ids).where(F.col("id") != F.col("of"))
    chunk = (F.col("way") == "in") & F.col("edge").isin("mentions", "contains")
    part = F.when((F.col("edge") == "part_of") & (F.col("kind") == "community"), "community").when(F.col("kind") == "entity", "related").when(chunk, "chunk")
    return near.select("of", part.alias("part"), "id", "title").where("part is not null").distinct()


def chunk_detail(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (of, part, id, title, start, end): what a chunk names, with the place of the title in its content or nulls, and its neighbours."""
    near = around(nodes, edges, ids)
    named = near.where("way = 'out' and edge in ('mentions', 'contains')").join(nodes.select(F.col("id").alias("of"), F.coalesce("content", F.lit("")).alias("_text")), "of")
    at = F.when(F.col("title") != "", F.instr("_text", F.col("title")) - 1)
    at = F.when(at >= 0, at)
    out = named.select("of", F.lit("entity").alias("part"), "id", "title", at.alias("start"), (at + F.length("title")).alias("end"))
    step = near.where("edge = 'next_chunk'").select("of", F.when(F.col("way") == "out", "next").otherwise("previous").alias("part"), "id", "title", F.lit(None).cast("int"), F.lit(None).cast("int"))
    return out.union(step).distinct()


def edge_evidence(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (source_id, target_id, chunk_id): the chunks of the index (chunk_id, entity_id) that have both ends of an edge."""
    a = index.select(F.col("entity_id").alias("source_id"), "chunk_id")
    b = index.select(F.col("entity_id").alias("target_id"), "chunk_id")
    return pairs.select("source_id", "target_id").distinct().join(a, "source_id").join(b, ["target_id", "chunk_id"]).select("source_id", "target_id", "chunk_id").distinct()


def row_detail(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (of, part, name, value): a table row's columns with their values, and the rows that it is linked with by table and id."""
    own = nodes.join(ids.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("of"), F.explode("properties").alias("name", "value")).where(~F.col("name").startswith("_"))
    table = nodes.select("id", F.try_element_at("properties", F.lit("_table_name")).alias("name")).where("name is not null")
    near = ends(edges).join(ids.select(F.col("id").alias("of")).distinct(), "of", "left_semi").join(table, "id")
    return own.select("of", F.lit("column").alias("part"), "name", "value").union(near.select("of", F.lit("row"), "name", F.col("id")).distinct())


def community_detail(nodes: DataFrame, edges: DataFrame, ids: DataFrame, keys: int = 10) -> DataFrame:
    """Rows (of, id, kind, title, links, key): a community's members with their number of edges, the most linked entities as keys."""
    member = around(nodes, edges, ids).where("way = 'in' and edge = 'part_of'").select("of", "id", "kind", "title").distinct()
    links = ends(edges).join(member.select(F.col("id").alias("of")).distinct(), "of", "left_semi").groupBy(F.col("of").alias("id")).agg(F.count("*").alias("links"))
    order = Window.partitionBy("of", F.col("kind") == "entity").orderBy(F.desc("links"), "id")
    both = member.join(links, "id").withColumn("_n", F.row_number().over(order))
    return both.select("of", "id", "kind", "title", "links", ((F.col("kind") == "entity") & (F.col("_n") <= keys)).alias("key"))


def statistics(nodes: DataFrame, edges: DataFrame, source: str | None = None) -> DataFrame:
    """One row: nodes, edges, entities, chunks, communities, tables, entities for a chunk that has any, and edges out of an entity, all of a source or the whole."""
    shown = of_source(nodes, source) if source else nodes
    kind = lambda k: F.count(F.when(F.col("kind") == k, 1))
    table = F.try_element_at("properties", F.lit("_table_name"))
    counts = shown.agg(F.count("*").alias("nodes"), kind("entity").alias("entities"), kind("chunk").alias("chunks"), kind("community").alias("communities"), F.count_distinct(table).alias("tables"))
    own = edges.join(shown.select(F.col("id").alias("source_id"), F.col("kind").alias("of")), "source_id")
    moved = own.agg(F.count("*").alias("edges"), F.count(F.when(F.col("of") == "entity", 1)).alias("out"))
    named = own.where("of = 'chunk' and kind in ('mentions', 'contains')").groupBy("source_id").agg(F.count_distinct("target_id").alias("n")).agg(F.coalesce(F.avg("n"), F.lit(0.0)).alias("entities_per_chunk"))
    one = counts.crossJoin(F.broadcast(moved)).crossJoin(F.broadcast(named))  # one row each
    return one.select("nodes", "edges", "entities", "chunks", "communities", "tables", "entities_per_chunk", F.when(F.col("entities") > 0, F.col("out") / F.col("entities")).otherwise(0.0).alias("edges_per_entity"))

"""Reinforcement, consolidation, decay and pruning of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.expressions import short_id
from graphloom.operators.linking import phrase_hubs

HOUR, DAY = 3600.0, 86400.0


def consolidate(nodes: DataFrame, now: float) -> DataFrame:
    """Rows (id, level, action): levels 0 to 3 are judged in order, so one pass may promote twice.

    level -1 means deletion. Ages are taken at an explicit time.
    """
    age, seen = F.lit(now) - F.col("updated_at"), F.col("access_count")
    judged = F.col("success_count") + F.col("failure_count")
    rate = F.when(judged > 0, F.col("success_count") / judged).otherwise(0.0)
    solid = (judged >= 10) & (rate >= 0.6)
    df = nodes.withColumn("l", F.col("level"))
    df = df.withColumn("l", F.when((F.col("l") == 0) & (seen >= 3), 1).when((F.col("l") == 0) & (age > 72 * HOUR), -1).otherwise(F.col("l")))
    df = df.withColumn("l", F.when((F.col("l") == 1) & (seen >= 10), 2).when((F.col("l") == 1) & (age > 90 * DAY), -1).otherwise(F.col("l")))
    df = df.withColumn("l", F.when((F.col("l") == 2) & solid, 3).when((F.col("l") == 2) & (age > 365 * DAY), -1).otherwise(F.col("l")))
    df = df.withColumn("l", F.when((F.col("l") == 3) & (judged >= 10) & (rate < 0.6), 2).otherwise(F.col("l")))
    action = F.when(F.col("l") == -1, "delete").when(F.col("l") > F.col("level"), "promote").when(F.col("l") < F.col("level"), "demote").otherwise("keep")
    return df.select("id", F.col("l").alias("level"), action.alias("action"))


def decay(nodes: DataFrame, factor: float = 0.95) -> DataFrame:
    return nodes.withColumn("vitality", F.col("vitality") * factor)


def prune(edges: DataFrame, least: float = 0.1) -> DataFrame:
    return edges.where(F.col("weight") >= least)


def reinforce(edges: DataFrame, pairs: DataFrame, success: bool = True) -> DataFrame:
    """Edge weights after uses of the pairs (source_id, target_id, maturity); new edges on success only.

    A pair that is given several times was used as often: its steps are added, and the weight is bounded once. A new edge
    starts at 0.1 with the largest step of its uses, and the others are added to that.
    """
    step = (0.1 if success else -0.15) / (1 + 0.02 * F.col("maturity"))
    used = pairs.withColumn("_step", step).groupBy("source_id", "target_id").agg(F.sum("_step").alias("_sum"), F.max("_step").alias("_most"))
    both = edges.join(used, ["source_id", "target_id"], "full_outer" if success else "left")
    bounded = lambda w: F.greatest(F.lit(-2.0), F.least(F.lit(5.0), w))
    # Edges that no pair touches stay as they are, even beyond the bounds.
    moved = F.when(F.col("_sum").isNull(), F.col("weight")).otherwise(bounded(F.coalesce(F.col("weight") + F.col("_sum"), 0.1 + F.col("_sum") - F.col("_most"))))
    return both.select("source_id", "target_id", F.coalesce("kind", F.lit("related")).alias("kind"), moved.alias("weight"))


def maintain(nodes: DataFrame, edges: DataFrame, now: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and the judgement of one round of upkeep: levels moved and the outlived gone, vitality decayed, weak edges pruned."""
    judged = consolidate(nodes, now)
    kept = decay(nodes.drop("level").join(judged.where("action <> 'delete'").select("id", "level"), "id"))
    gone = judged.where("action = 'delete'").select("id")
    left = prune(edges).join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return kept, left.select(edges.columns), judged


def touch(nodes: DataFrame, uses: DataFrame, now: float) -> DataFrame:
    """Nodes after uses (id): each use counts, and the newest time stands."""
    counted = uses.groupBy("id").agg(F.count("*").alias("_uses"))
    both = nodes.join(counted, "id", "left")
    return both.withColumns({"access_count": F.col("access_count") + F.coalesce("_uses", F.lit(0)), "updated_at": F.when(F.col("_uses") > 0, F.lit(now)).otherwise(F.col("updated_at"))}).drop("_uses")


def needs_backfill(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (id, vector, phrases) of nodes with content that lack a vector or any CONTAINS edge; a second pass finds none of those mended."""
    linked = edges.where("kind = 'contains'").select(F.col("source_id").alias("id"), F.lit(True).alias("_has")).distinct()
    both = nodes.where(F.coalesce(F.length("content"), F.lit(0)) > 0).join(linked, "id", "left")
    return both.select("id", (F.coalesce(F.size("embedding"), F.lit(0)) <= 0).alias("vector"), F.col("_has").isNull().alias("phrases")).where("vector or phrases")


def backfill(nodes: DataFrame, edges: DataFrame, locale: str = "en", extractors: tuple[str, ...] = (), vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with what was missing filled in: phrase hubs that nodes without CONTAINS edges get, and vectors where given.

    vectors: (id, embedding) for nodes that lack one. Hubs are entities tagged _phrase, shared by all nodes with the phrase.
    A second run adds nothing, but for nodes in which no phrase is found.
    """
    need = needs_backfill(nodes, edges)
    text = nodes.join(need.where("phrases").select("id"), "id", "left_semi").select(F.col("id").alias("doc_id"), F.concat_ws("\n", "title", "content").alias("text"))
    found = phrase_hubs(text, locale, extractors=extractors).select("doc_id", F.lower("phrase").alias("phrase")).distinct()
    hub = short_id("phrase_", F.col("phrase"))
    new = found.select(hub.alias("source_id"), "phrase").distinct().join(nodes.select(F.col("id").alias("source_id")), "source_id", "left_anti")
    fill = {"id": F.col("source_id"), "kind": F.lit("entity"), "title": F.col("phrase"), "content": F.lit(""), "tags": F.array(F.lit("_phrase"))}
    hubs = new.select(*[fill.get(f.name, F.lit(0 if f.dataType.typeName() in ("integer", "long", "double") else None)).cast(f.dataType).alias(f.name) for f in nodes.schema])
    linked = found.select(F.col("doc_id").alias("source_id"), hub.alias("target_id"), F.lit("contains").alias("kind"), F.lit(0.5).alias("weight"))
    whole = nodes
    if vectors is not None:
        given = vectors.select("id", F.col("embedding").alias("_given"))
        lacks = F.coalesce(F.size("embedding"), F.lit(0)) <= 0
        whole = nodes.join(given, "id", "left").withColumn("embedding", F.when(lacks, F.coalesce("_given", "embedding")).otherwise(F.col("embedding"))).select(nodes.columns)
    return whole.unionByName(hubs), edges.select("source_id", "target_id", "kind", "weight").unionByName(linked)

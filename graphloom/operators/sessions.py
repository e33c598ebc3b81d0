"""What agents and people did: sessions, turns, tool calls, decisions and their outcomes as nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.expressions import short_id

#: Weight of the edge that ties an activity to its session, and of those between activities.
EDGES = {"part_of": 1.0, "depends_on": 0.8, "produced": 0.7, "resulted_in": 1.0, "followed_by": 1.0, "contains": 1.0}


def edge(df: DataFrame, source, target, kind: str) -> DataFrame:
    return df.select(source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("kind"), F.lit(EDGES[kind]).alias("weight"))


def conversation(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of conversations (conv_id, turn, role, text): a session for each, which contains its user turns; every turn follows the one before."""
    session = F.concat(F.lit("session_"), F.col("conv_id").cast("string"))
    here = F.concat_ws(":", F.lit("turn"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    nodes = turns.select(here.alias("id"), F.lit("observation").alias("kind"), F.col("role").alias("title"), F.col("text").alias("content"), F.array(F.concat(F.lit("_turn_"), "role")).alias("tags"))
    sessions = turns.select(session.alias("id"), F.lit("session").alias("kind"), F.concat(F.lit("Session "), F.substring(session, 1, 8)).alias("title"), F.lit("").alias("content"), F.array(F.lit("_session")).alias("tags")).distinct()
    order = Window.partitionBy("conv_id").orderBy("turn")
    following = turns.select("conv_id", "turn", here.alias("a"), F.lead("turn").over(order).alias("n")).where("n is not null")
    to = F.concat_ws(":", F.lit("turn"), F.col("conv_id").cast("string"), F.col("n").cast("string"))
    return sessions.union(nodes), edge(turns.where("role = 'user'"), session, here, "contains").union(edge(following, F.col("a"), to, "followed_by"))


def activities(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a log (session, at, kind, title, content, refers): each is part of its session and follows the one before;
    a decision depends on what it refers to, an outcome results from its decision, an observation is produced by its source."""
    own = short_id("act_", F.col("session"), F.col("at").cast("string"), F.col("kind"), F.col("title"))
    log = log.withColumn("id", own)
    nodes = log.select("id", "kind", "title", F.substring(F.coalesce("content", F.lit("")), 1, 2000).alias("content"), F.array("kind").alias("tags"), F.col("at").alias("created_at"))
    order = Window.partitionBy("session").orderBy("at", "id")
    after = log.select("id", F.lead("id").over(order).alias("n")).where("n is not null")
    out = edge(log, F.col("id"), F.col("session"), "part_of").union(edge(after, F.col("id"), F.col("n"), "followed_by"))
    refers = log.where("refers is not null")
    out = out.union(edge(refers.where("kind = 'decision'"), F.col("id"), F.col("refers"), "depends_on"))
    out = out.union(edge(refers.where("kind = 'outcome'"), F.col("refers"), F.col("id"), "resulted_in"))
    return nodes, out.union(edge(refers.where("kind = 'observation'"), F.col("refers"), F.col("id"), "produced"))


def timeline(nodes: DataFrame, edges: DataFrame, session: str) -> DataFrame:
    """The nodes that are part of a session, in order of time."""
    held = edges.where((F.col("kind") == "part_of") & (F.col("target_id") == session)).select(F.col("source_id").alias("id"))
    return nodes.join(held, "id", "left_semi").orderBy("created_at", "id")


def decision_chain(edges: DataFrame, decision: str) -> DataFrame:
    """Rows (id, role): the outcomes that a decision resulted in, and the lessons learned from it or from them."""
    outcomes = edges.where((F.col("kind") == "resulted_in") & (F.col("source_id") == decision)).select(F.col("target_id").alias("id"))
    roots = outcomes.union(edges.sparkSession.createDataFrame([(decision,)], "id string"))
    lessons = edges.where("kind = 'learned_from'").join(roots.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(F.col("source_id").alias("id"))
    return outcomes.distinct().withColumn("role", F.lit("outcome")).union(lessons.distinct().withColumn("role", F.lit("lesson")))


def session_info(log: DataFrame) -> DataFrame:
    """Rows (session, calls, first_at, last_at, kinds) of a log."""
    return log.groupBy("session").agg(F.count("*").alias("calls"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def expired(sessions: DataFrame, now: float, seconds: float = 3600.0) -> DataFrame:
    """Sessions (session, last_at) whose last use is longer ago than allowed."""
    return sessions.where(F.lit(now) - F.col("last_at") > seconds)

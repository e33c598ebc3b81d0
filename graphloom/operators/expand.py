"""From a query and its first hits to their surroundings: anchors, six paths of expansion, and chains of evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import graph
from graphloom.operators.lineage import written


@dataclass
class Budget:
    """How much expansion may add: for one anchor, for one category, and in all."""

    per_anchor: int = 20
    per_category: int = 10
    total: int = 100


def category_anchors(categories: DataFrame, query: str) -> DataFrame:
    """Rows (id, title, way) of categories (id, title) that a query names: 0 where the whole label is in it, 1 where a word of it is in the label."""
    words = list(dict.fromkeys(w.lower() for w in T.re.findall("[A-Za-z가-힣]{2,}", query)))
    low = F.lower(F.coalesce("title", F.lit("")))
    word: Column = F.lit(False)
    for w in words:
        word = word | F.contains(low, F.lit(w))
    way = F.when((low != "") & F.contains(F.lit(query.lower()), low), 0).when((low != "") & word, 1)
    return categories.select("id", "title", way.alias("way")).where("way is not null")


def table_anchors(query: str, hints: dict[str, list[str]]) -> list[str]:
    """Tables one of whose hints is in the query, in their order."""
    q = query.lower()
    return [t for t, words in hints.items() if any(w and w.lower() in q for w in words)]


def expand(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, categories: DataFrame, budget: Budget | None = None) -> DataFrame:
    """Rows (id, reason, hops, anchor): seeds (id, rank), then what they cite, siblings in categories (id), parts and wholes,
    neighbouring chunks, mentions of seeds that are entities, and rows related to those.

    The first path that gives a node wins; each anchor and category gives a few, all together no more than the budget.
    Only edges at the few seeds and categories are looked at, and only nodes that these lead to.
    """
    b = budget or Budget()
    kinds = graph.among(nodes.select("id", "kind"), seeds)
    start = written(seeds.join(F.broadcast(kinds), "id", "left").select(F.col("id").alias("anchor"), "rank", "kind"), "start")
    cats = categories.select(F.col("id").alias("anchor"), F.lit(0).alias("rank"), F.lit("concept").alias("kind"))

    def path(order: int, reason: str, anchors: DataFrame, kinds: list[str] | None, way: str, most: int | None) -> DataFrame:
        held = edges.where(F.col("kind").isin(kinds)) if kinds else edges
        sides = []
        if way in ("both", "out"):
            sides.append(held.select(F.col("source_id").alias("anchor"), F.col("target_id").alias("id")))
        if way in ("both", "in"):
            sides.append(held.select(F.col("target_id").alias("anchor"), F.col("source_id").alias("id")))
        steps = sides[0] if len(sides) == 1 else sides[0].union(sides[1])
        found = steps.join(F.broadcast(anchors.select("anchor", "rank")), "anchor").distinct()  # anchors: a query's few seeds
        if most is not None:
            found = found.withColumn("_n", F.row_number().over(Window.partitionBy("anchor").orderBy("id"))).where(F.col("_n") <= most).drop("_n")
        return found.select("id", F.lit(order).alias("path"), F.lit(reason).alias("reason"), "rank", "anchor")

    chunks, entities = start.where("kind = 'chunk'"), start.where("kind = 'entity'")
    every = [
        path(1, "references", start, ["references"], "both", b.per_anchor),
        path(2, "category_sibling", cats, None, "both", b.per_category),
        path(3, "document_chunk", start, ["contains", "part_of"], "both", b.per_anchor),
        path(4, "chunk_next", chunks, ["next_chunk"], "both", None),
        path(5, "entity_mention", entities, ["mentions"], "in", b.per_anchor),
        path(6, "related", entities, ["related"], "both", b.per_anchor),
    ]
    out = start.select(F.col("anchor").alias("id"), F.lit(0).alias("path"), F.lit("seed").alias("reason"), "rank", F.lit(None).cast("string").alias("anchor"))
    for p in every:
        out = out.unionByName(p.withColumn("anchor", F.col("anchor").cast("string")))
    once = Window.partitionBy("id").orderBy("path", "rank", "anchor")
    out = written(out.withColumn("_n", F.row_number().over(once)).where("_n = 1"), "paths")
    out = graph.among(out, graph.among(nodes.select("id"), out))
    out = out.orderBy("path", "rank", "anchor", "id").limit(b.total)
    return out.select("id", "reason", F.when(F.col("path") == 0, 0).otherwise(1).alias("hops"), "anchor")


def topological(ids: list[str], edges: list[tuple[str, str]]) -> list[str]:
    """A short list of ids with sources before targets; what a cycle holds comes last, in the order given."""
    into = dict.fromkeys(ids, 0)
    ways = {i: [] for i in ids}
    for a, b in edges:
        if a in into and b in into:
            ways[a].append(b)
            into[b] += 1
    ready, out = [i for i in ids if not into[i]], []
    while ready:
        out.append(here := ready.pop(0))
        for b in ways[here]:
            into[b] -= 1
            if not into[b]:
                ready.append(b)
    return out + [i for i in ids if i not in out]


#: Kinds of edges that order the steps of a chain.
ORDERED = ("caused", "resulted_in", "depends_on", "learned_from", "produced", "followed_by", "next_chunk")


def evidence_chain(nodes: DataFrame, edges: DataFrame, seeds: list[str], query: str, most: int = 8, depth: int = 3) -> DataFrame:
    """Rows (step, id, role, content, facts) for a few seeds and the bridges on paths between neighbours among the first five.

    Seeds, bridges and their edges are a handful of rows, ordered on the driver; contents are cut down by Spark.
    """
    seeds = list(dict.fromkeys(seeds))[:most]
    ids = list(seeds)
    for a, b in zip(seeds[:5], seeds[1:5], strict=False):
        for row in graph.shortest_path(edges, a, b, depth).collect():  # one row at most
            ids += [x for x in row.path.split(">") if x not in ids]
    ends = [(r.source_id, r.target_id) for r in edges.where(F.col("kind").isin(*ORDERED) & F.col("source_id").isin(ids) & F.col("target_id").isin(ids)).select("source_id", "target_id").distinct().orderBy("source_id", "target_id").collect()]
    order = topological(ids, ends)[:most]
    steps = nodes.sparkSession.createDataFrame([(i, x, "seed" if x in seeds else "bridge") for i, x in enumerate(order)], "step int, id string, role string")
    told = nodes.join(F.broadcast(steps), "id")  # `most` rows
    return told.select("step", "id", "role", T.compress(F.col("content"), query).alias("content"), T.facts(F.coalesce("content", F.lit(""))).alias("facts"))

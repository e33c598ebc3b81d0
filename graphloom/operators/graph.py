"""Tables as a graph, neighbourhoods, paths, rank and communities on edges (source_id, target_id, kind, weight)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.lineage import written
from graphloom.operators.structured import newest
from graphloom.schema import DEFAULT_FLOW, FLOW


def row_id(table: str, key: Column) -> Column:
    return F.concat(F.lit(f"{table}:"), key.cast("string"))


def row_text(table: str, columns: list[Column]) -> Column:
    """table: v1 | v2 ..., without nulls, empty strings and zeros."""
    texts = [c.cast("string") for c in columns]
    kept = [F.when(~t.isin("", "0", "0.0", "None", "null"), t) for t in texts]
    return F.concat(F.lit(f"{table}: "), F.concat_ws(" | ", *kept))


def nodes_of(df: DataFrame, table: str, key: str, text: list[str]) -> DataFrame:
    """One node for each row, its id derived from table and key."""
    return df.select(row_id(table, F.col(key)).alias("id"), F.lit("entity").alias("kind"), row_id(table, F.col(key)).alias("title"), row_text(table, [F.col(c) for c in text]).alias("content"))


def key_edges(df: DataFrame, table: str, key: str, fk: str, to_table: str, to: DataFrame | None = None, to_key: str | None = None) -> DataFrame:
    """RELATED edges along a foreign key; with the target table, dangling keys give none."""
    if to is not None:
        df = df.join(to.select(F.col(to_key).alias(fk)).distinct(), fk, "left_semi")
    return df.where(F.col(fk).isNotNull()).select(row_id(table, F.col(key)).alias("source_id"), row_id(to_table, F.col(fk)).alias("target_id"), F.lit("related").alias("kind"), F.lit(0.8).alias("weight"))


def bridge_edges(df: DataFrame, a: str, a_table: str, b: str, b_table: str) -> DataFrame:
    """A bridge table of two foreign keys is edges between their targets."""
    return df.select(row_id(a_table, F.col(a)).alias("source_id"), row_id(b_table, F.col(b)).alias("target_id"), F.lit("related").alias("kind"), F.lit(0.8).alias("weight")).distinct()


def bridge_columns(columns: list[str], key: str | None, foreign: list[str]) -> tuple[str, str] | None:
    """The first two foreign keys of a table that holds little else, else nothing."""
    other = [c for c in columns if c not in foreign and c != key]
    return (foreign[0], foreign[1]) if len(foreign) >= 2 and len(other) <= 1 else None


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).union(edges.select(F.col("target_id"), F.col("source_id")))


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """Rows (id, hop) reached in at most hops steps either way, each once; seeds are left out.

    The two-way edges are written once for all hops, so their sources are read and joined only once.
    """
    steps = both_ways(edges)
    steps = written(steps, "steps") if hops > 1 else steps
    seen = seeds.select("id", F.lit(0).alias("hop"))
    front = seen
    for hop in range(1, hops + 1):
        front = front.join(steps, front["id"] == steps["a"]).select(F.col("b").alias("id")).distinct()
        front = front.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop))
        if hop < hops:
            front = written(front, "front")
        seen = seen.union(front)
    return seen.where("hop > 0")


def shortest_path(edges: DataFrame, start: str, goal: str, most: int = 5) -> DataFrame:
    """One row (path, hops): the least path in order of its ids, or no row.

    Each hop joins the front, which is written, with the edges, and the search ends where it meets the goal or nothing new.
    """
    steps = both_ways(edges)
    front = edges.sparkSession.createDataFrame([(start, [start])], "id string, path array<string>")
    seen, none = front, front.limit(0)
    for _ in range(most if start != goal else 0):
        front = front.join(steps, front["id"] == steps["a"]).select(F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path"))
        front = written(front.groupBy("id").agg(F.min("path").alias("path")).join(seen.select("id"), "id", "left_anti"), "front")
        met = front.where(F.col("id") == goal)
        if not met.isEmpty():
            return met.select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).alias("hops"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return none.select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).alias("hops"))


def follow(edges: DataFrame, node: str, kind: str, direction: str = "both") -> DataFrame:
    out = edges.where((F.col("kind") == kind) & (F.col("source_id") == node)).select(F.col("target_id").alias("id"), F.lit("out").alias("way"))
    into = edges.where((F.col("kind") == kind) & (F.col("target_id") == node)).select(F.col("source_id").alias("id"), F.lit("in").alias("way"))
    return out if direction == "outgoing" else into if direction == "incoming" else out.union(into)


def flow(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain(*FLOW.items())])
    return F.coalesce(F.try_element_at(table, kind), F.lit(DEFAULT_FLOW))


def among(rows: DataFrame, few: DataFrame) -> DataFrame:
    """The rows of a table whose id is among a query's few ids (id). Only these few are sent to the driver."""
    return rows.join(F.broadcast(few.select("id")), "id", "left_semi")


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges with an end among the ids (id), with n, how many of their ends are. Ids may be as many as nodes, so they are merged, not broadcast."""
    s = ids.select(F.col("id").alias("source_id"), F.lit(1).alias("s")).hint("merge")
    t = ids.select(F.col("id").alias("target_id"), F.lit(1).alias("t")).hint("merge")
    both = edges.join(s, "source_id", "left").join(t, "target_id", "left")
    return both.withColumn("n", F.coalesce("s", F.lit(0)) + F.coalesce("t", F.lit(0))).where("n > 0").drop("s", "t")


def personalized_rank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 50, tol: float = 1e-6, every: int = 5) -> DataFrame:
    """Rows (id, score) of the rank over the seeds' two-hop surroundings, after so many rounds or when one moves less than tol.

    An edge counts for each of its ends that was processed, that is a seed or next to one.
    Nodes without edges lose their mass. seeds: (id, weight), normalised here. Where no seed has an
    edge, the seeds' own weights are returned. Of the edges only those around the seeds are written, their steps once, and ranks
    every few rounds, where they are compared. Steps and ranks grow with the edges: they are merged by id, which a round's sums
    leave in place for the next, and none of them reaches the driver.
    """
    start = written(seeds.groupBy("id").agg(F.sum("weight").alias("weight")), "seeds")
    edges = edges.select("source_id", "target_id", "kind", "weight")
    near = touching(edges, start)
    done = start.select("id").union(near.select("source_id")).union(near.select("target_id")).distinct()
    e = touching(edges, written(done, "done"))
    e = e.select("source_id", "target_id", (F.col("weight") * flow(F.col("kind")) * F.col("n")).alias("w"))
    e = e.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "w").union(e.select(F.col("target_id"), F.col("source_id"), "w"))
    e = e.groupBy("a", "b").agg(F.sum("w").alias("w"))
    out = e.groupBy("a").agg(F.sum("w").alias("total"))
    step = written(e.join(out.hint("merge"), "a").select("a", "b", (F.col("w") / F.col("total")).alias("p")), "step")
    if step.isEmpty():
        return start.select("id", F.col("weight").alias("score"))
    whole = start.agg(F.sum("weight").alias("whole"))
    p = written(start.crossJoin(F.broadcast(whole)).select("id", (F.col("weight") / F.col("whole")).alias("p0")), "start")  # whole is one row
    rank = p.select("id", F.col("p0").alias("r"))
    for i in range(1, rounds + 1):
        before = rank
        moved = rank.join(step.hint("merge"), rank["id"] == step["a"]).select(F.col("b").alias("id"), F.lit(None).cast("double").alias("p0"), (F.col("r") * F.col("p")).alias("m"))
        rank = p.withColumn("m", F.lit(None).cast("double")).unionByName(moved).groupBy("id").agg(F.max("p0").alias("p0"), F.sum("m").alias("m"))
        rank = rank.select("id", ((1 - damping) * F.coalesce("p0", F.lit(0.0)) + damping * F.coalesce("m", F.lit(0.0))).alias("r"))
        if (i + 1) % every == 0 and i + 1 < rounds:
            rank = written(rank, "rank")  # the next round is compared with it
        if i % every == 0 and i < rounds:
            rank = written(rank, "rank")
            moved_by = rank.join(before.select("id", F.col("r").alias("o")), "id", "full_outer").agg(F.sum(F.abs(F.coalesce("r", F.lit(0.0)) - F.coalesce("o", F.lit(0.0))))).first()[0]
            if (moved_by or 0.0) < tol:
                break
    return rank.select("id", F.col("r").alias("score"))


def chunk_rank(edges: DataFrame, seeds: DataFrame, nodes: DataFrame, rounds: int = 50) -> DataFrame:
    """The rank with chunks in mind: chunk seeds count half as much again, weak edges are left out,
    and two chunks are joined by next_chunk alone. nodes: (id, kind)."""
    chunk = nodes.where("kind = 'chunk'").select("id").distinct()
    s = chunk.select(F.col("id").alias("source_id"), F.lit(1).alias("s"))
    t = chunk.select(F.col("id").alias("target_id"), F.lit(1).alias("t"))
    e = edges.where(F.col("weight") * flow(F.col("kind")) >= 0.15).join(s, "source_id", "left").join(t, "target_id", "left")
    e = e.where("s is null or t is null or kind = 'next_chunk'").select(edges.columns)
    raised = seeds.join(chunk.withColumn("c", F.lit(1)), "id", "left").select("id", F.when(F.col("c") == 1, F.col("weight") * 1.5).otherwise(F.col("weight")).alias("weight"))
    return personalized_rank(e, raised, rounds=rounds)


def communities(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """Rows (id, label) by synchronous weighted label propagation; ties go to the smallest label.

    Ends after so many rounds, or when a round changes nothing. Labels are written every round.
    """
    w = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "weight").union(edges.select(F.col("target_id"), F.col("source_id"), "weight"))
    w = written(w.groupBy("a", "b").agg(F.sum("weight").alias("weight")), "links")
    label = w.select(F.col("a").alias("id"), F.col("a").alias("label")).distinct()
    before = None
    for _ in range(rounds):
        # Dealt out by the voting node once, which serves both the votes and the choice among them.
        said = w.join(label, w["b"] == label["id"]).select("a", "label", "weight").repartition("a")
        votes = said.groupBy("a", "label").agg(F.round(F.sum("weight"), 9).alias("v")).where("v is not null")
        label = written(votes.groupBy(F.col("a").alias("id")).agg(F.min_by("label", F.struct((-F.col("v")).alias("v"), "label")).alias("label")), "label")
        now = label.agg(F.bit_xor(F.xxhash64("id", "label"))).first()[0]
        if now == before:
            break
        before = now
    return label


def community_nodes(labels: DataFrame, nodes: DataFrame, least: int = 3, titles: int = 10) -> tuple[DataFrame, DataFrame]:
    """A node for each community of some members, summed up by the first of their titles, and PART_OF edges (0.5) to it."""
    sized = labels.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    held = labels.join(sized, "label").join(nodes.select("id", "title"), "id", "left")
    order = Window.partitionBy("label").orderBy("title", "id")
    first = held.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= titles)
    told = first.groupBy("label", "n").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "title"))), lambda x: x["title"]), "; ").alias("content"))
    name = F.concat(F.lit("community_"), F.substring(F.md5("label"), 1, 16))
    made = told.select(name.alias("id"), F.lit("community").alias("kind"), F.format_string("Community of %d", "n").alias("title"), "content")
    return made, held.select(F.col("id").alias("source_id"), name.alias("target_id"), F.lit("part_of").alias("kind"), F.lit(0.5).alias("weight"))


def linked(pairs: DataFrame) -> DataFrame:
    """Rows (id, label) of the connected components of pairs (a, b); the label is the smallest id.

    Every round takes the least label around each node and then the label of that label, which halves paths.
    """
    w = written(pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))).distinct(), "pairs")
    label = w.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    before = None
    while True:
        label = written(label, "label")
        now = label.agg(F.bit_xor(F.xxhash64("id", "label"))).first()[0]
        if now == before:
            return label
        before = now
        around = w.join(label, w["b"] == label["id"]).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        least = label.join(around, "id").select("id", F.least("label", "near").alias("label"))
        up = label.select(F.col("id").alias("label"), F.col("label").alias("up"))
        label = least.join(up, "label").select("id", F.least("label", "up").alias("label"))


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges by source, target and kind; the new weight wins."""
    names = ["source_id", "target_id", "kind", "weight"]
    both = old.select(*names, F.lit(0).alias("v")).union(new.select(*names, F.lit(1).alias("v")))
    return newest(both, names[:3], [F.col("v").desc(), F.col("weight").desc()]).select(*names)


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the ids and the edges at them."""
    gone = ids.select("id").distinct()
    edges = edges.join(gone, edges["source_id"] == gone["id"], "left_anti")
    return nodes.join(gone, "id", "left_anti"), edges.join(gone, edges["target_id"] == gone["id"], "left_anti")


def final_targets(same: DataFrame) -> DataFrame:
    """Rows (old, new) of pairs (old, new) with chains followed to their ends: a into b and b into c make a and b into c.

    Of several targets of one node the smallest counts; pairs that run in a circle go to the smallest id of the circle.
    """
    once = same.where("old <> new").groupBy("old").agg(F.min("new").alias("new"))
    if once.join(once.select(F.col("old").alias("new")), "new", "left_semi").isEmpty():
        return once
    once = written(once, "pairs")
    group = linked(once.select(F.col("old").alias("a"), F.col("new").alias("b")))
    goes = once.select(F.col("old").alias("id"), F.lit(True).alias("goes"))
    # Every node has one target, so all nodes of a group but one go, or all of them where it holds a circle.
    end = group.join(goes, "id", "left").groupBy("label").agg(F.coalesce(F.min(F.when(F.col("goes").isNull(), F.col("id"))), F.min("id")).alias("new"))
    return group.join(end, "label").where("id <> new").select(F.col("id").alias("old"), "new")


def merge_nodes(edges: DataFrame, same: DataFrame) -> DataFrame:
    """Edges with ends replaced by (old, new), chains followed, without self loops, the largest weight of each triple."""
    same = final_targets(same)
    s = same.select(F.col("old").alias("source_id"), F.col("new").alias("ns"))
    t = same.select(F.col("old").alias("target_id"), F.col("new").alias("nt"))
    moved = edges.join(s, "source_id", "left").join(t, "target_id", "left").select(F.coalesce("ns", "source_id").alias("source_id"), F.coalesce("nt", "target_id").alias("target_id"), "kind", "weight")
    return moved.where("source_id <> target_id").groupBy("source_id", "target_id", "kind").agg(F.max("weight").alias("weight"))


def merge_contents(nodes: DataFrame, same: DataFrame) -> DataFrame:
    """Nodes after (old, new) pairs merged: contents that the target lacks are added, tags united, counts summed, the greatest vitality kept.

    The old nodes go; each of their contents stands behind the target's own, in order of their ids. Chains are followed to
    their ends. Only nodes that a pair names are grouped; all others pass as they are. A target that is no node takes nothing in.
    """
    same = final_targets(same)
    names = ["id", "kind", "title", "content", "tags", "access_count", "success_count", "failure_count", "vitality"]
    here = same.join(nodes.select(F.col("id").alias("new")), "new", "left_semi")
    ends = here.select(F.col("old").alias("id"), "new").union(here.select(F.col("new").alias("id"), F.lit(None).cast(dict(here.dtypes)["new"])).distinct())
    into = nodes.join(ends, "id").withColumn("to", F.coalesce("new", "id"))
    part = F.struct(F.col("new").isNotNull().alias("late"), "id", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("access_count", "success_count", "failure_count")]
    own = lambda c: F.max(F.when(F.col("new").isNull(), F.col(c))).alias(c)
    grouped = into.groupBy("to").agg(F.sort_array(F.collect_list(part)).alias("parts"), own("kind"), own("title"), *sums, F.max("vitality").alias("vitality"))
    joined = F.aggregate(F.transform("parts", lambda p: p["content"]), F.lit(""), lambda all_, c: F.when((c == "") | F.contains(all_, c), all_).otherwise(F.trim(F.concat_ws("\n\n", F.nullif(all_, F.lit("")), c))))
    tags = F.array_distinct(F.flatten(F.transform("parts", lambda p: p["tags"])))
    merged = grouped.select(F.col("to").alias("id"), "kind", "title", joined.alias("content"), tags.alias("tags"), "access_count", "success_count", "failure_count", "vitality")
    rest = nodes.join(ends.select("id"), "id", "left_anti").select(*names)
    return rest.unionByName(merged.select(*[F.col(n).cast(nodes.schema[n].dataType).alias(n) for n in names]))


def node_stats(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count("*").alias("n"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (what, name, n): nodes by kind and by level, edges by kind."""
    by = lambda df, what, c: df.groupBy(F.lit(what).alias("what"), F.col(c).cast("string").alias("name")).agg(F.count("*").alias("n"))
    out = by(nodes, "node", "kind").union(by(edges, "edge", "kind"))
    return out.union(by(nodes, "level", "level")) if "level" in nodes.columns else out


def hubs(edges: DataFrame, kind: str = "mentions", limit: int = 10) -> DataFrame:
    """Rows (id, n): the nodes that most edges of a kind lead to."""
    return edges.where(F.col("kind") == kind).groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "id").limit(limit)


def property_samples(nodes: DataFrame, most: int = 3) -> DataFrame:
    """Rows (table, property, samples): the first distinct values of each property, a few of each, without collecting them all."""
    pairs = nodes.select(F.try_element_at("properties", F.lit("_table_name")).alias("table"), F.explode("properties").alias("property", "value")).where("table is not null and property <> '_table_name'").distinct()
    order = Window.partitionBy("table", "property").orderBy("value")
    some = pairs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    return some.groupBy("table", "property").agg(F.array_join(F.sort_array(F.collect_list("value")), ", ").alias("samples"))

"""The whole evidence search: seeds from texts, vectors and hints, their surroundings, signals, and a choice for variety."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions.expressions import cosine, total, word_list
from graphloom.operators import evidence, expand, graph, metadata, search, tools
from graphloom.operators.lineage import written

#: What a way to a node is worth, by its reason; the weights of the four signals.
PRIOR = {"seed": 1.0, "references": 0.85, "document_chunk": 0.7, "chunk_next": 0.55, "entity_mention": 0.5, "related": 0.5, "ppr_discovery": 0.45, "category_sibling": 0.4}
WEIGHTS = {"lexical": 0.45, "semantic": 0.25, "graph": 0.2, "structural": 0.1}
#: Scores of nodes that vectors, or a moved vector, find alone; of a table's rows that a hint finds; of what a seed cites.
BY_VECTOR, BY_FEEDBACK, BY_HINT, COMPANION = 0.08, 0.06, 0.96, 0.9


def seeds(nodes: DataFrame, query: str, limit: int = 20, vector: list[float] | None = None, hints: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows (id, score, rank): full text with tags and keywords first, then what vectors find beyond it, what a vector moved
    towards the best texts finds, rows of tables that the query hints at, and what the parts of the query find.

    A node keeps its best score and its first place. A few times `limit` rows, from a bounded number of scans.
    """
    keywords = F.try_element_at("properties", F.lit("_search_keywords"))
    first = written(search.seeds(search.bm25(nodes, query, limit, tags_col="tags", keywords=keywords)), "seeds")
    lists = [first.select("id", F.col("seed_score").alias("score"), "rank")]
    ranked = lambda df, score: df.select("id", F.lit(score).alias("score"), (F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1).alias("rank"))  # noqa: E731  over `limit` rows
    if vector is not None:
        lists.append(ranked(search.vector_top(nodes, vector, limit, "id", "embedding").join(first, "id", "left_anti"), BY_VECTOR))
        near = nodes.join(F.broadcast(first.where("rank < 3").select("id", "rank")), "id").where(F.size("embedding") == len(vector))
        held = [list(r.embedding) for r in near.select("embedding", "rank").orderBy("rank").collect()]  # three rows
        if held:
            moved = search.vector_top(nodes, evidence.feedback_query(vector, held), limit // 2, "id", "embedding")
            lists.append(ranked(moved.join(lists[0].union(lists[1]), "id", "left_anti"), BY_FEEDBACK))
    if hints and (more := tools.table_hint_seeds(nodes, query, first, hints)) is not None:
        lists.append(ranked(more.select("id", "score"), BY_HINT))
    parts = [p for p in T.decompose(query) if p and p != query]
    if len(T.decompose(query)) > 1 and parts:
        each = tools.searched(nodes.select("id", "title", "content"), parts, limit)
        fused = tools.sub_query_scores([first.select("id", "rank"), *each])
        lists.append(fused.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1))  # a few times `limit` rows
    every = None
    for i, part in enumerate(lists):
        part = part.withColumn("rank", F.col("rank") + 1000 * i)
        every = part if every is None else every.unionByName(part)
    return every.groupBy("id").agg(F.max("score").alias("score"), F.min("rank").alias("rank"))


def structural(labels: list[str], as_of: int) -> Column:
    """How well a node fits the categories named, how far it is to be trusted, and whether it is current."""
    category = F.lower(F.coalesce(F.try_element_at("properties", F.lit("category")), F.lit("")))
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower)
    no = F.lit(False)
    named, tagged = no, no
    for label in labels:
        named, tagged = named | F.contains(category, F.lit(label)), tagged | F.exists(tags, lambda t: F.contains(t, F.lit(label)))  # noqa: B023
    score = F.when(named & (category != ""), 0.4).otherwise(0.0) + F.when(tagged, 0.1).otherwise(0.0) + 0.02 * metadata.authority(F.col("properties")) + F.when(metadata.is_current(F.col("properties"), as_of), 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), score)


def signals(nodes: DataFrame, found: DataFrame, labels: list[str], as_of: int, vector: list[float] | None = None) -> DataFrame:
    """Rows of candidates (id, total, lexical, semantic, graph, structural, reason, anchor, ...) by all their signals.

    found: (id, reason, anchor, lexical), a few hundred rows. Lexical, semantic and graph signals are scaled over the candidates; several
    candidates of one document lift each other; what a candidate cites comes up to nine tenths of its total.
    """
    both = nodes.join(F.broadcast(found), "id").withColumn("query_id", F.lit(0))
    prior = F.create_map(*[F.lit(x) for x in chain(*PRIOR.items())])
    both = both.withColumn("_graph", F.coalesce(F.try_element_at(prior, F.col("reason")), F.lit(0.3)))
    meaning = cosine(F.coalesce(F.col("embedding").cast("array<double>"), F.array().cast("array<double>")), F.array(*[F.lit(float(x)) for x in vector])) if vector is not None else F.lit(0.0)
    both = both.withColumn("_semantic", meaning)
    one = both.select(
        "query_id", "id", "reason", "anchor", F.try_element_at("properties", F.lit("doc_id")).alias("doc"), F.coalesce(F.try_element_at("properties", F.lit("category")), F.lit("")).alias("category"), F.coalesce(F.try_element_at("properties", F.lit("_table_name")), F.lit("")).alias("table"),
        F.array_distinct(word_list(F.lower(F.coalesce("content", F.lit(""))))).alias("words"), search.scaled(F.col("lexical"), ["query_id"]).alias("lexical"),
        (search.scaled(F.col("_semantic"), ["query_id"]) if vector is not None else F.lit(0.0)).alias("semantic"), search.scaled(F.col("_graph"), ["query_id"]).alias("graph"), structural(labels, as_of).alias("structural"),
    )
    mixed = one.withColumn("mixed", total([F.lit(w) * F.col(c) for c, w in WEIGHTS.items()]))
    n = F.count("*").over(Window.partitionBy("doc"))
    lifted = mixed.withColumn("mixed", F.when((F.coalesce("doc", F.lit("")) != "") & (n > 1), F.least(F.lit(1.0), F.col("mixed") + 0.05 * F.log(n + 1.0))).otherwise(F.col("mixed")))
    cites = lifted.select(F.col("id").cast("string").alias("anchor"), F.col("mixed").alias("of"))
    joined = lifted.join(cites, "anchor", "left")
    return joined.withColumn("total", F.when((F.col("reason") == "references") & F.col("of").isNotNull(), F.greatest("mixed", COMPANION * F.col("of"))).otherwise(F.col("mixed"))).drop("mixed", "of")


def find(nodes: DataFrame, edges: DataFrame, query: str, as_of: int, k: int = 6, limit: int = 20, vector: list[float] | None = None, hints: dict[str, list[str]] | None = None, budget: expand.Budget | None = None, per_doc: int = 2, second: DataFrame | None = None, share: float = 0.1) -> DataFrame:
    """Rows (id, rank, total, reason, anchor): the evidence for a query.

    Seeds of all kinds are expanded along all six paths within a budget, and by rank over the graph around them; all
    candidates are scored by their signals and chosen for variety, categories that the query names first. nodes have the
    node table's columns, edges (source_id, target_id, kind, weight). as_of: the time, as valid_from and valid_to
    state it. second: scores (id, score) of a reranker of one's own, of which a share is mixed in, but not for rows of tables.
    """
    start = written(seeds(nodes, query, limit, vector, hints), "seeds")
    anchors = written(expand.category_anchors(nodes.where("kind = 'concept'").select("id", "title"), query), "anchors")
    labels = sorted({r.title.lower() for r in anchors.orderBy("way", "title").limit(50).collect() if r.title})
    around = written(expand.expand(nodes, edges, start, anchors.select("id"), budget), "around")
    ranked = graph.personalized_rank(edges, start.select("id", F.col("score").alias("weight"))).orderBy(F.desc("score"), "id").limit(3 * k)
    beyond = written(ranked.join(F.broadcast(around.select("id")), "id", "left_anti"), "beyond")  # 3 * k rows, and a budget of them around
    beyond = graph.among(beyond, graph.among(nodes.select("id"), beyond))
    held = around.join(start.select("id", "score"), "id", "left").select("id", "reason", "anchor", F.coalesce("score", F.lit(0.0)).alias("lexical"))
    held = held.union(beyond.select("id", F.lit("ppr_discovery"), F.lit(None).cast("string"), F.col("score") * 0.5))
    told = written(signals(nodes, held, labels, as_of, vector), "signals")
    if second is not None:
        text = told.where("table = ''").select("id", F.col("total").alias("score"))
        mixed = tools.blended(text, second, share).select("id", F.col("score").alias("mixed"))
        told = written(told.join(mixed, "id", "left").withColumn("total", F.coalesce("mixed", "total")).drop("mixed"), "signals")
    chosen = evidence.choose(told.withColumn("doc_id", F.coalesce(F.nullif("doc", F.lit("")), F.col("id").cast("string"))), k, per_doc=per_doc, categories=[r.title for r in anchors.where("way = 0").orderBy("title").limit(50).collect()])
    return chosen.join(told.select("id", "total", "reason", "anchor"), "id").select("id", "rank", "total", "reason", "anchor")

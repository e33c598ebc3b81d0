"""Searches made of others: hybrid, legacy, by intent and by level; reading, comparing and deepening their results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions.expressions import snippet
from graphloom.operators import expand, graph, postings, search
from graphloom.operators.lineage import written

#: Words of a query that prefer a kind, and by how much.
KIND_HINTS = {"lesson": "실패 에러 오류 장애 교훈 배운 주의 failure error incident lesson postmortem"}
KIND_BOOST = 0.05
#: Weights of relevance, importance, recency, vitality and context by intent.
WEIGHTS = {
    "similar_decisions": (0.45, 0.20, 0.15, 0.05, 0.15),
    "past_failures": (0.40, 0.25, 0.20, 0.05, 0.10),
    "related_rules": (0.45, 0.20, 0.10, 0.10, 0.15),
    "reasoning_chain": (0.40, 0.20, 0.20, 0.05, 0.15),
    "context_explore": (0.30, 0.15, 0.15, 0.10, 0.30),
    "general": (0.55, 0.15, 0.20, 0.10, 0.0),
}


def supersede(rows: DataFrame) -> DataFrame:
    """Of nodes with one title, four characters or more, and one beginning of 200 characters, the newest; ties to the smaller id."""
    title = F.lower(F.trim(F.coalesce("title", F.lit(""))))
    head = F.lower(F.trim(F.substring(F.coalesce("content", F.lit("")), 1, 200)))
    alone = F.when(F.length(title) < 4, F.col("id").cast("string"))
    order = Window.partitionBy(title, head, alone).orderBy(F.col("updated_at").desc(), "id")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def exclude_seen(rows: DataFrame, seen: DataFrame) -> DataFrame:
    return rows.join(seen.select("id").distinct(), "id", "left_anti")


def seed_union(lists: list[DataFrame]) -> DataFrame:
    """Rows (id, score, reason) of several lists; the first list that has an id decides."""
    out = None
    for i, rows in enumerate(lists):
        part = rows.select("id", "score", "reason", F.lit(i).alias("_list"))
        out = part if out is None else out.union(part)
    first = Window.partitionBy("id").orderBy("_list", F.col("score").desc())
    return out.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("id", "score", "reason")


def merged_lists(lists: list[DataFrame], limit: int = 10) -> DataFrame:
    """Rows (id, list, rank) of rankings (id, rank) one behind the other, each id where it comes first."""
    out = None
    for i, rows in enumerate(lists):
        part = rows.select("id", F.lit(i).alias("list"), "rank")
        out = part if out is None else out.union(part)
    first = out.groupBy("id").agg(F.min(F.struct("list", "rank")).alias("m"))
    return first.select("id", "m.list", "m.rank").orderBy("list", "rank", "id").limit(limit)


def sub_query_scores(rankings: list[DataFrame]) -> DataFrame:
    """Rows (id, score): reciprocal ranks of several rankings (id, rank from 0), scaled to 0.10 up to 0.95."""
    union = rankings[0].select("id", "rank")
    for r in rankings[1:]:
        union = union.union(r.select("id", "rank"))
    fused = search.fuse(union)
    top = fused.agg(F.max("score").alias("top"))  # one row
    return fused.crossJoin(F.broadcast(top)).select("id", (0.10 + 0.85 * F.col("score") / F.col("top")).alias("score"))


def hybrid(full_text: DataFrame, fuzzy: DataFrame, vectors: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """Rows (id, score): 0.8 for full text, else 0.6 for fuzzy, else 0.7 for vectors, and 0.2 for each further list that has the id."""
    lists = [(full_text, 0.8), (fuzzy, 0.6)] + ([(vectors, 0.7)] if vectors is not None else [])
    rows = None
    for i, (df, own) in enumerate(lists):
        part = df.select("id", F.lit(own).alias("own"), F.lit(i).alias("list")).distinct()
        rows = part if rows is None else rows.union(part)
    score = F.least(F.lit(1.0), F.min(F.struct("list", "own"))["own"] + 0.2 * (F.count("*") - 1))
    return rows.groupBy("id").agg(score.alias("score")).orderBy(F.col("score").desc(), "id").limit(limit)


def resonance(nodes: DataFrame, now: float, intent: str = "general", context: list[str] | None = None) -> Column:
    """Relevance, importance, recency and vitality weighed by intent, and the likeness of tags to the context's."""
    w = WEIGHTS.get(intent, WEIGHTS["general"])
    days = F.greatest(F.lit(0.0), (F.lit(now) - F.col("updated_at")) / 86400)
    judged = F.col("success_count") + F.col("failure_count")
    importance = F.when(judged > 0, F.col("success_count") / judged).otherwise(F.lit(0.5)) if "importance" not in nodes.columns else F.col("importance")
    asked = F.array(*[F.lit(t.lower()) for t in context or []]).cast("array<string>")
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower)
    union = F.size(F.array_union(tags, asked))
    like = F.when(union > 0, F.size(F.array_intersect(tags, asked)) / union).otherwise(F.lit(0.0))
    return w[0] * F.col("relevance") + w[1] * importance + w[2] * F.exp(-0.05 * days) + w[3] * F.col("vitality") + w[4] * like


def legacy(nodes: DataFrame, query: str, now: float, limit: int = 10, vector: list[float] | None = None, edges: DataFrame | None = None, kinds: list[str] | None = None, corpus: int = 0, least: float = 0.10, drop: float = 0.30, intent: str = "general", context: list[str] | None = None) -> DataFrame:
    """Rows (id, relevance, resonance): full text, then vectors that it missed, synonyms where there are few, rank over
    the graph, boosts for kinds and tags; sorted by resonance, without hubs of phrases, the newest of copies.

    nodes have the columns of the node table. Every stage after the scans works on a few times `limit` rows.
    """
    docs = nodes.select("id", "title", "content")
    found = search.seeds(search.bm25(docs, query, limit * 2)).select("id", F.col("seed_score").alias("score"), F.lit("fts").alias("reason"))
    lists = [found]
    if vector is not None:
        near = search.vector_top(nodes, vector, limit * 2, "id", "embedding").join(found.select("id"), "id", "left_anti")
        top = near.agg(F.max("score").alias("top"))  # one row
        alpha = min(0.85, max(0.3, (corpus - 500) / 5000 + 0.3))
        lists.append(near.crossJoin(F.broadcast(top)).where(F.col("score") >= F.greatest(F.lit(least), F.col("top") * (1 - drop))).select("id", (F.col("score") * alpha).alias("score"), F.lit("vector").alias("reason")))
    if seed_union(lists).count() < limit:
        lists += [search.bm25(docs, q, limit).select("id", F.lit(0.5).alias("score"), F.lit("synonym").alias("reason")) for q in T.expand_synonyms(query)[:3]]
    held = seed_union(lists)
    if edges is not None:
        ranked = graph.personalized_rank(edges, held.select("id", F.col("score").alias("weight")), rounds=10).orderBy(F.col("score").desc(), "id").limit(limit * 2)
        both = held.join(ranked.withColumnRenamed("score", "p"), "id", "full_outer")
        score = F.when(F.col("score").isNull(), F.col("p") * 0.8).otherwise(F.least(F.lit(1.0), F.col("score") + 0.1 * F.coalesce("p", F.lit(0.0))))
        held = both.select("id", score.alias("score"), F.coalesce("reason", F.lit("graph")).alias("reason"))
    few = nodes.join(F.broadcast(held), "id")  # a few times `limit` rows
    score = F.col("score")
    if kinds:
        score = F.when(F.col("kind").isin(*kinds), F.least(F.lit(1.0), score * 1.5)).otherwise(score)
    preferred = [k for k, words in KIND_HINTS.items() if any(w in query.lower() for w in words.split())]
    if preferred:
        score = F.when(F.col("kind").isin(*preferred), F.least(F.lit(1.0), score + KIND_BOOST)).otherwise(score)
    tags = F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower), lambda t: F.length(t) >= 2)
    hits = F.size(F.array_intersect(tags, F.array(*[F.lit(w) for w in dict.fromkeys(query.lower().split())])))
    few = few.withColumn("relevance", F.when(hits > 0, F.least(F.lit(1.0), score + 0.03 * hits)).otherwise(score))
    few = few.withColumn("resonance", resonance(few, now, intent, context))
    few = supersede(few.where(~F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), "_phrase")))
    return few.orderBy(F.col("resonance").desc(), "id").limit(limit).select("id", "relevance", "resonance")


#: What an intent follows from its hits: steps of (edge kind, way, kinds of the hits or all, factor or a fixed score).
FOLLOWED = {
    "similar_decisions": [("resulted_in", "out", None, 0.7)],
    "past_failures": [("resulted_in", "in", ["outcome"], 0.8), ("learned_from", "in", None, None)],
    "related_rules": [(None, "both", None, 0.5)],
    "reasoning_chain": [("resulted_in", "out", None, 0.8), ("learned_from", "in", ["outcome"], 0.75)],
}
WANTED = {"similar_decisions": ["decision"], "past_failures": ["outcome", "decision", "lesson"], "related_rules": ["rule", "lesson"], "reasoning_chain": ["decision"]}


def by_intent(hits: DataFrame, nodes: DataFrame, edges: DataFrame, intent: str, now: float, limit: int = 10, context: list[str] | None = None) -> DataFrame:
    """Rows (id, kind, relevance, resonance) of hits (id, score) and what an intent adds to them along edges, weighed as it asks."""
    held = hits.join(nodes, "id").select("id", "kind", "failure_count", F.col("score").alias("relevance"))
    if intent == "past_failures":
        held = held.where("kind = 'lesson' or kind in ('outcome', 'decision') and failure_count > 0")
    if intent == "context_explore":
        ranked = graph.personalized_rank(edges, hits.select("id", F.col("score").alias("weight")), damping=0.75, rounds=10).orderBy(F.col("score").desc(), "id").limit(limit * 2)
        both = hits.join(ranked.withColumnRenamed("score", "p"), "id", "full_outer")
        score = F.when(F.col("score").isNull(), F.col("p")).when(F.col("p").isNull(), F.col("score")).otherwise(F.least(F.lit(1.0), 0.6 * F.col("score") + 0.4 * F.col("p")))
        held = both.select("id", score.alias("relevance")).join(nodes.select("id", "kind", "failure_count"), "id").select("id", "kind", "failure_count", "relevance")
    for kind, way, of, factor in FOLLOWED.get(intent, []):
        from_ = held.where(F.col("kind").isin(*of)) if of else held
        steps = edges.where(F.col("kind") == kind) if kind else edges
        out = steps.select(F.col("source_id").alias("from"), F.col("target_id").alias("to"), "weight")
        into = steps.select(F.col("target_id").alias("from"), F.col("source_id").alias("to"), "weight")
        moves = out if way == "out" else into if way == "in" else out.union(into)
        score = F.lit(0.6) if factor is None else F.col("relevance") * factor * (F.col("weight") if kind is None else F.lit(1.0))
        new = from_.join(moves, from_["id"] == moves["from"]).groupBy(F.col("to").alias("id")).agg(F.max(score).alias("relevance"))
        new = new.join(nodes.select("id", "kind", "failure_count"), "id").join(held.select("id"), "id", "left_anti")
        new = new.where("kind in ('rule', 'lesson', 'concept')") if intent == "related_rules" else new
        held = held.unionByName(new.select("id", "kind", "failure_count", "relevance"))
    full = held.select("id", "relevance").join(nodes, "id")
    scored = full.withColumn("resonance", resonance(full, now, intent, context))
    place = [F.when(F.col("kind") == "decision", 0).when(F.col("kind") == "outcome", 1).when(F.col("kind") == "lesson", 2).otherwise(99)] if intent == "reasoning_chain" else []
    return scored.orderBy(*place, F.col("resonance").desc(), "id").limit(limit).select("id", "kind", "relevance", "resonance")


def level_of(query: str) -> str:
    """high for words of overview, low for names, numbers and abbreviations, hybrid where both or neither stand."""
    broad = any(w in query.lower() for w in "전체 요약 개요 동향 트렌드 주요 전반 정리 무엇이 어떤 overview summary trend overall general main key major pattern comprehensive".split())
    narrow = bool(re.search(r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*|[A-Z]{2,}|\d{4}[-년]", query))
    return "high" if broad and not narrow else "low" if narrow and not broad else "hybrid"


def dual_level(nodes: DataFrame, query: str, now: float, level: str = "auto", limit: int = 10, **options) -> DataFrame:
    """Rows (id, score): single nodes, communities, or both fused by rank."""
    level = level_of(query) if level == "auto" else level
    rank = lambda df: df.withColumn("rank", F.row_number().over(Window.orderBy(F.col("resonance").desc(), "id")) - 1).select("id", "rank", "resonance")  # noqa: E731  over `limit` rows
    low = rank(legacy(nodes.where("kind <> 'community'"), query, now, limit, **options))
    high = rank(legacy(nodes, query, now, limit * 2, kinds=["community"], **options).limit(limit))
    if level in ("low", "high"):
        return (low if level == "low" else high).select("id", F.col("resonance").alias("score"))
    return search.fuse(low.select("id", "rank").union(high.select("id", "rank"))).orderBy(F.col("score").desc(), "id").limit(limit)


def pseudo_query(title: str, content: str, most: int = 8) -> str:
    """What one may ask about a document: the first words of its first sentence, or its title where it says little."""
    content = content.strip()
    if len(content) < 30:
        return title.strip()
    first = re.split(r"(?<=[.!?。])\s+", content, maxsplit=1)[0].strip()
    return " ".join((first if len(first) >= 20 else content[:80]).split()[:most])


def calibrate(docs: DataFrame, sample: int = 20, k: int = 10) -> tuple[float, float]:
    """Mean reciprocal rank of some documents when asked for by their own first words, and the share that a reranker should get.

    The sample is chosen by hash, so it is the same at every run; all its queries are answered by one scan of the texts.
    """
    text = F.coalesce("content", F.lit(""))
    some = docs.where((F.trim(F.coalesce("title", F.lit(""))) != "") & (F.trim(text) != "")).orderBy(F.xxhash64("id"), "id").limit(sample)
    asked = [(r.id, q) for r in some.select("id", "title", F.substring(text, 1, 4000).alias("content")).collect() if (q := pseudo_query(r.title, r.content))]
    if not asked:
        return 0.7, 0.1
    queries = docs.sparkSession.createDataFrame(asked, f"query_id {dict(docs.dtypes)['id']}, query string")
    found = postings.bm25_many(queries, k, postings.fields(docs)).where("id = query_id").agg(F.sum(1.0 / F.col("rank"))).first()[0]
    mean = (found or 0.0) / len(asked)
    return mean, 0.0 if mean >= 0.85 else 0.2 if mean <= 0.55 else 0.1


def search_page(nodes: DataFrame, query: str, limit: int = 10, category: str | None = None, kind: str | None = None, seen: DataFrame | None = None) -> DataFrame:
    """Rows (id, kind, title, snippet, score): full text, twice as much as asked, then filtered by category, kind and what was seen."""
    hits = search.bm25(nodes.select("id", "title", "content"), query, limit * 2)
    full = nodes.join(F.broadcast(hits), "id")  # 2 * limit rows
    if category is not None:
        full = full.where(F.try_element_at("properties", F.lit("category")) == category)
    if kind is not None:
        full = full.where(F.col("kind") == kind)
    if seen is not None:
        full = exclude_seen(full, seen)
    return full.orderBy(F.col("score").desc(), "id").limit(limit).select("id", "kind", "title", snippet(F.coalesce("content", F.lit("")), query.split()).alias("snippet"), "score")


def around(nodes: DataFrame, edges: DataFrame, node: str, limit: int = 20) -> DataFrame:
    """Rows (id, kind, title, edge, way) next to a node, by edge kind and id."""
    out = edges.where(F.col("source_id") == node).select(F.col("target_id").alias("id"), F.col("kind").alias("edge"), F.lit("out").alias("way"))
    into = edges.where(F.col("target_id") == node).select(F.col("source_id").alias("id"), F.col("kind").alias("edge"), F.lit("in").alias("way"))
    return nodes.select("id", "kind", "title").join(out.union(into).distinct(), "id").orderBy("edge", "way", "id").limit(limit)


def read_document(nodes: DataFrame, edges: DataFrame, doc: str, page: int = 0, size: int = 10) -> DataFrame:
    """Rows (position, id, content): a page of a document's chunks in order."""
    held = edges.where((F.col("kind") == "contains") & (F.col("source_id") == doc)).select(F.col("target_id").alias("id"))
    parts = nodes.join(held, "id").withColumn("position", F.try_element_at("properties", F.lit("chunk_index")).cast("int"))
    return parts.where((F.col("position") >= page * size) & (F.col("position") < (page + 1) * size)).select("position", "id", "content").orderBy("position", "id")


def document(nodes: DataFrame, edges: DataFrame, ids: DataFrame, query: str = "", most: int = 50, whole: int = 5, brief: int = 80) -> DataFrame:
    """Rows (doc, position, id, content, relevant) of documents' chunks in order, the first `most` of each.

    With a query only the chunks that hold most of its words, `whole` of each document, come in full; others by their
    beginning. ids: documents (id); a chunk stands for the document that contains it, and for itself where none does.
    """
    contains = edges.where("kind = 'contains'").select(F.col("source_id").alias("doc"), F.col("target_id").alias("id"))
    asked = ids.select("id").distinct()
    parent = asked.join(contains, "id", "left").select(F.coalesce("doc", "id").alias("doc"), "id")
    docs = parent.select("doc").distinct()
    held = docs.join(contains, "doc", "left").select("doc", F.coalesce("id", "doc").alias("id"))
    chunk = nodes.join(held, "id").select("doc", "id", "kind", F.coalesce("content", F.lit("")).alias("content"), F.coalesce(F.try_element_at("properties", F.lit("chunk_index")).try_cast("int"), F.lit(0)).alias("position"))
    order = Window.partitionBy("doc").orderBy("position", "id")
    some = chunk.where("kind = 'chunk'").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    terms = list(dict.fromkeys(query.lower().split()))
    if not terms:
        return some.select("doc", "position", "id", "content", F.lit(True).alias("relevant"))
    overlap = sum((F.contains(F.lower("content"), F.lit(t)).cast("int") for t in terms), F.lit(0))
    best = F.row_number().over(Window.partitionBy("doc").orderBy(overlap.desc(), "position", "id")) <= whole
    told = some.withColumn("relevant", best)
    return told.select("doc", "position", "id", F.when(F.col("relevant"), F.col("content")).otherwise(F.concat(F.substring("content", 1, brief), F.lit("…"))).alias("content"), "relevant")


def deep_search(nodes: DataFrame, edges: DataFrame, query: str, limit: int = 5, read: int = 2) -> DataFrame:
    """Rows (part, id, text): hits, what is next to the first one, and the beginnings of the first documents read."""
    hits = search.bm25(nodes.select("id", "title", "content"), query, limit).collect()  # limit rows
    if not hits:
        return nodes.select(F.lit("hit").alias("part"), "id", F.col("content").alias("text")).limit(0)
    ids = [h.id for h in hits]
    found = nodes.where(F.col("id").isin(ids)).select(F.lit("hit").alias("part"), "id", snippet(F.coalesce("content", F.lit("")), query.split()).alias("text"))
    near = around(nodes, edges, ids[0]).select(F.lit("next").alias("part"), "id", F.col("title").alias("text"))
    whole = nodes.where(F.col("id").isin(ids[:read])).select(F.lit("read").alias("part"), "id", F.substring("content", 1, 2000).alias("text"))
    return found.union(near).union(whole)


def searched(docs: DataFrame, queries: list[str], limit: int) -> list[DataFrame]:
    """A ranking (id, rank from 0) for each query, all from one scan of documents (id, title, content)."""
    asked = docs.sparkSession.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    found = written(postings.bm25_many(asked, limit, postings.fields(docs)).select("query_id", "id", (F.col("rank") - 1).alias("rank")), "found")
    return [found.where(F.col("query_id") == i).select("id", "rank") for i in range(len(queries))]


def compare_search(nodes: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Rows (id, list, rank) of the topics that a comparison names, each searched by itself."""
    return merged_lists(searched(nodes.select("id", "title", "content"), T.compared(query), limit), limit)


def table_hint_seeds(docs: DataFrame, query: str, hits: DataFrame, hints: dict[str, list[str]], least: int = 3, most: int = 5) -> DataFrame | None:
    """Rows (id, score, reason): for tables that the query hints at and that have few hits, a search with the table's name in front."""
    out = None
    for table in expand.table_anchors(query, hints):
        own = docs.where(F.try_element_at("properties", F.lit("_table_name")) == table)
        if own.join(hits.select("id"), "id", "left_semi").limit(least).count() < least:
            part = search.bm25(own, f"{table} {query}", most).select("id", F.lit(0.96).alias("score"), F.lit("table_hint").alias("reason"))
            out = part if out is None else out.union(part)
    return out


def blended(first: DataFrame, second: DataFrame, share: float = 0.3) -> DataFrame:
    """Rows (id, score): a search's scores (id, score) with a share of a reranker's mixed in, where it gives one."""
    again = second.select("id", F.col("score").alias("again"))
    return first.join(again, "id", "left").select("id", F.when(F.col("again").isNull(), F.col("score")).otherwise((1 - share) * F.col("score") + share * F.col("again")).alias("score"))



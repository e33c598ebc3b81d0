"""Full-text, exact and vector search, fusion of rankings, reranking and retrieval metrics."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.expressions import cosine, occurrences, rank_score, total
from graphloom.functions.text import query_without_particles, without_particles
from graphloom.operators.lineage import written


def bm25(docs: DataFrame, query: str, k: int = 10, id_col: str = "id", title_col: str = "title", text_col: str = "content", tags_col: str | None = None, keywords: Column | None = None) -> DataFrame:
    """Rows (id, score): BM25 on substrings blended with a substring score by the size of the corpus.

    One pass over the texts makes a narrow row for each document; it is written, so statistics (one row) and scores come
    from it without reading a text again. Tags and search keywords count as text, and by themselves.
    """
    terms = query.lower().split()
    if not terms:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    low = F.lower(F.array_join(F.coalesce(F.col(tags_col), F.array().cast("array<string>")), " ")) if tags_col else F.lit("")
    d = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(title_col, F.lit(""))).alias("t"), F.lower(F.coalesce(text_col, F.lit(""))).alias("c"), low.alias("g"), F.lower(F.coalesce(keywords, F.lit("")) if keywords is not None else F.lit("")).alias("k"))
    x = F.concat_ws(" ", "t", "c", *[F.when(F.col(f) != "", F.col(f)) for f, there in (("g", tags_col), ("k", keywords is not None)) if there])
    words = F.regexp_count(x, F.lit(r"\S+"))
    narrow = {"dl": words, "title_all": F.contains("t", F.lit(query.lower()))}
    for i, t in enumerate(terms):
        narrow |= {f"f{i}": occurrences(F.col("c"), t), f"t{i}": F.contains("t", F.lit(t)), f"x{i}": F.contains(x, F.lit(t))}
        if tags_col:
            narrow[f"g{i}"] = F.contains("g", F.lit(t))
        if keywords is not None:
            narrow[f"k{i}"] = F.contains("k", F.lit(t))
    for i, (a, b) in enumerate(zip(terms, terms[1:], strict=False)):
        narrow[f"p{i}"] = F.contains(x, F.lit(f"{a} {b}"))
    d = written(d.select("id", *[c.alias(n) for n, c in narrow.items()]), "bm25")
    stats = d.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum(F.col(f"x{i}").cast("int")).alias(f"df{i}") for i in range(len(terms))])
    d = d.where(reduce(lambda a, b: a | b, [F.col(f"x{i}") for i in range(len(terms))])).crossJoin(F.broadcast(stats))  # one row
    best, sub, hit = [], [], []
    for i in range(len(terms)):
        idf = F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1)
        tf, in_title = F.col(f"f{i}"), F.col(f"t{i}")
        best += [F.when(tf > 0, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))).otherwise(0.0), F.when(in_title, 3 * idf).otherwise(0.0)]
        sub += [F.when(in_title, 2.0).otherwise(0.0), F.when(tf > 0, 1.0).otherwise(0.0)]
        sub += [F.when(F.col(f"g{i}"), 1.0).otherwise(0.0)] if tags_col else []
        sub += [F.when(F.col(f"k{i}"), 1.5).otherwise(0.0)] if keywords is not None else []
        hit.append(((tf > 0) | in_title).cast("double"))
    sub.append(F.when(F.col("title_all"), 3.0 * len(terms)).otherwise(0.0))
    for i in range(len(terms) - 1):
        pair = F.when(F.col(f"p{i}"), 1.5).otherwise(0.0)
        best.append(pair)
        sub.append(pair)
    if len(terms) >= 2:
        cover = total(hit) / len(terms)
        sub.append(F.when(cover >= 0.8, 1.5 * len(terms)).when(cover >= 0.5, 0.5 * len(terms)).otherwise(0.0))
    w = F.least(F.lit(0.8), F.greatest(F.lit(0.1), (F.col("n") - 500) / 5000))
    scored = d.select("id", (total(best) * w + total(sub) * (1 - w)).alias("score"))
    return scored.where("score > 0").orderBy(F.col("score").desc(), "id").limit(k)


def bm25_korean(docs: DataFrame, query: str, k: int = 10, title_col: str = "title", text_col: str = "content", **options) -> DataFrame:
    """The same with the particles of Korean words taken off in texts and query alike."""
    plain = docs.withColumns({c: without_particles(F.coalesce(c, F.lit(""))) for c in (title_col, text_col)})
    return bm25(plain, query_without_particles(query), k, title_col=title_col, text_col=text_col, **options)


def exact(docs: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Rows in which a column contains the needle as it is."""
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.contains(c, F.lit(needle)), F.lit(False))
    return docs.where(test)


def vector_top(vectors: DataFrame, query: list[float], k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(F.col(id_col).alias("id"), cosine(F.col(vec_col).cast("array<double>"), q).alias("score"))
    return scored.where("score > 0").orderBy(F.col("score").desc(), "id").limit(k)


def fuse(rankings: DataFrame, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of rows (id, rank), ranks from 0."""
    return rankings.groupBy("id").agg(F.sum(1.0 / (F.lit(constant) + F.col("rank"))).alias("score"))


def seeds(scored: DataFrame) -> DataFrame:
    order = Window.orderBy(F.col("score").desc(), "id")  # over the few rows of a top k
    return scored.withColumn("rank", F.row_number().over(order) - 1).select("id", "rank", rank_score(F.col("rank")).alias("seed_score"))


def longest_by_category(rows: DataFrame, most: int) -> DataFrame:
    """The longest rows (id, category, n) of each category, some few of each; ties to the smaller id."""
    order = Window.partitionBy("category").orderBy(F.col("n").desc(), "id")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def scaled(value: Column, per: list[str]) -> Column:
    """Min-max in each query; constant signals are 1."""
    w = Window.partitionBy(*per)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(1.0))


def rerank(candidates: DataFrame) -> DataFrame:
    """Rows (query_id, id, doc_id, total) from lexical, semantic, graph and structural signals and coverage."""
    weights = {"lexical": 0.45, "semantic": 0.25, "graph": 0.20, "structural": 0.10}
    mixed = total([F.lit(w) * scaled(F.col(c), ["query_id"]) for c, w in weights.items()])
    n = F.count("*").over(Window.partitionBy("query_id", "doc_id"))
    bonus = F.when(n > 1, 0.05 * F.log(n + 1.0)).otherwise(0.0)
    return candidates.withColumn("mixed", mixed).withColumn("bonus", bonus).select("query_id", "id", "doc_id", F.least(F.lit(1.0), F.col("mixed") + F.col("bonus")).alias("total"))


def resonance(nodes: DataFrame, now: float) -> DataFrame:
    """Rows (id, resonance) from relevance, importance, recency and vitality at an explicit time."""
    days = F.greatest(F.lit(0.0), (F.lit(now) - F.col("updated_at")) / 86400)
    score = 0.55 * F.col("relevance") + 0.15 * F.col("importance") + 0.20 * F.exp(-0.05 * days) + 0.10 * F.col("vitality")
    return nodes.select("id", score.alias("resonance"))


def metrics(run: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """Per query precision, recall, their harmonic mean, reciprocal rank and nDCG at k; run has (query_id, id, rank from 1)."""
    marks = relevant.select("query_id", "id").distinct().withColumn("rel", F.lit(1))
    n = marks.groupBy("query_id").agg(F.count("*").alias("relevant"))
    top = run.where(F.col("rank") <= k).join(marks, ["query_id", "id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    per = top.groupBy("query_id").agg(F.sum("rel").alias("hits"), F.max(F.when(F.col("rel") == 1, 1.0 / F.col("rank")).otherwise(0.0)).alias("rr"), F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + 1.0))
    f1 = F.when(F.col("hits") > 0, 2 * F.col("hits") / (k + F.col("relevant"))).otherwise(0.0)
    return per.join(n, "query_id").select("query_id", (F.col("hits") / k).alias("precision"), (F.col("hits") / F.col("relevant")).alias("recall"), f1.alias("f1"), "rr", (F.col("dcg") / ideal).alias("ndcg"))


def decay(age_days: float, rate: float = 0.05) -> float:
    return math.exp(-rate * age_days)

"""Evidence for a query: candidates from full text and their surroundings, reranked, then chosen for variety."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions.expressions import cosine, jaccard, total, word_list
from graphloom.operators import expand, search, tools
from graphloom.operators.lineage import written


def fuzzy(docs: DataFrame, query: str, k: int = 10, least: float = 0.4, id_col: str = "id", title_col: str = "title", text_col: str = "content", tags_col: str | None = None) -> DataFrame:
    """Rows (id, score) by the likeness of character runs: of title and query, or of single words, tags among them.

    One pass over the rows; every distinct word of a batch is compared once. The first ten words of a query are compared.
    """
    asked = query.lower()[:200]
    terms = list(dict.fromkeys(query.lower().split()))[:10]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[float]] = {}
        for b in batches:
            scores = []
            for title, head, tags in zip(b.title, b["head"], b.tags, strict=True):
                words = [*title.split(), *head.split(), *tags]
                for w in words:
                    if w not in known:
                        known[w] = [difflib.SequenceMatcher(None, t, w).ratio() for t in terms]
                best = [max((known[w][i] for w in words), default=0.0) for i in range(len(terms))]
                mean = sum(best) / len(best) if best else 0.0
                scores.append(max(difflib.SequenceMatcher(None, asked, title).ratio(), mean) + 0.1 * sum(t in title for t in terms))
            if len(known) > 200_000:
                known.clear()
            yield pd.DataFrame({"id": b.id, "score": pd.Series(scores, dtype="float64")})

    # Only the first hundred words of the content count for this measure.
    head = F.concat_ws(" ", F.slice(word_list(F.lower(F.coalesce(text_col, F.lit("")))), 1, 100))
    none = F.array().cast("array<string>")
    tags = F.transform(F.coalesce(F.col(tags_col), none), F.lower) if tags_col else none
    rows = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(title_col, F.lit(""))).alias("title"), head.alias("head"), tags.alias("tags"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(each, f"id {kind}, score double").where(F.col("score") >= least).orderBy(F.col("score").desc(), "id").limit(k)


def feedback_query(query: list[float], found: list[list[float]], own: float = 0.7) -> list[float]:
    """The query vector moved towards the mean of a few found vectors."""
    if not found:
        return list(query)
    return [own * q + (1 - own) * sum(v[i] for v in found) / len(found) for i, q in enumerate(query)]


def max_similarity(tokens: DataFrame, query: list[list[float]], doc_col: str, vec_col: str) -> DataFrame:
    """Rows (id, score): the mean over the query's vectors of the nearest of a document's vectors."""
    best = [F.max(cosine(F.col(vec_col).cast("array<double>"), F.array(*[F.lit(float(x)) for x in q]))).alias(f"b{i}") for i, q in enumerate(query)]
    per = tokens.groupBy(F.col(doc_col).alias("id")).agg(*best)
    return per.select("id", (total([F.col(f"b{i}") for i in range(len(query))]) / len(query)).alias("score"))


def choose(candidates: DataFrame, k: int = 10, balance: float = 0.7, same: float = 0.85, per_doc: int = 2, categories: list[str] | None = None, companions: int = 3) -> DataFrame:
    """Rows (query_id, id, rank) chosen one by one: high total, unlike what is chosen already.

    candidates: (query_id, id, doc_id, total, words) and, if they are there, category, reason, anchor and table; a hundred or
    so for each query. First the best of each category asked for; then near copies of a chosen one are dropped, and a
    document gives no more than per_doc. What a chosen one cites (reason references, anchor its id) comes with it,
    and is never dropped as a copy. Rows of tables stand apart: they go by total alone.
    """
    named = [c for c in ("category", "reason", "anchor", "table") if c in candidates.columns]

    def each(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["total", "id"], ascending=[False, True]).reset_index(drop=True)
        get = lambda c: g[c].fillna("").tolist() if c in g else [""] * len(g)
        category, reason, anchor, table = (get(c) for c in ("category", "reason", "anchor", "table"))
        words = [frozenset(w) for w in g.words]
        like, left, picked, used = [0.0] * len(g), [i for i in range(len(g)) if not table[i]], [], {}

        def take(i: int) -> None:
            left.remove(i)
            picked.append(i)
            used[g.doc_id[i]] = used.get(g.doc_id[i], 0) + 1
            for j in left:
                both = len(words[i] & words[j])
                like[j] = max(like[j], both / max(1, len(words[i]) + len(words[j]) - both))

        fits = lambda i: used.get(g.doc_id[i], 0) < per_doc
        for c in sorted(categories or []):
            best = next((i for i in left if category[i] == c and fits(i)), None)
            if best is not None and like[best] < same and len(picked) < k:
                take(best)
        while len(picked) < k:
            open_ = [i for i in left if fits(i) and (like[i] < same or reason[i] == "references")]
            if not open_:
                break
            i = max(open_, key=lambda j: (balance * g.total[j] - (1 - balance) * like[j], -j))
            take(i)
            for j in [j for j in left if reason[j] == "references" and anchor[j] == g.id[i]][:companions]:
                take(j)
        rows = [i for i in range(len(g)) if table[i]][:k]
        if rows:
            picked = sorted(picked + rows, key=lambda i: (-g.total[i], i)) if picked else rows
        picked = picked[:k]
        return pd.DataFrame({"query_id": g.query_id[picked], "id": g.id[picked], "rank": range(1, len(picked) + 1)})

    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    slim = candidates.select("query_id", "id", "doc_id", "total", "words", *named)
    return slim.groupBy("query_id").applyInPandas(each, f"query_id {kinds['query_id']}, id {kinds['id']}, rank int")


def evidence(docs: DataFrame, query: str, k: int = 10, seeds: int = 30, siblings: int = 10, edges: DataFrame | None = None) -> DataFrame:
    """Rows (query_id, id, rank) for documents (id, title, content, category).

    Full-text seeds, of the whole query and of its parts, bring in the longest documents of their categories and of
    those that the query names, and with edges what they cite; all are reranked by their signals and chosen for
    variety, the named categories first. All but the full-text scans works on the few candidates.
    """
    first = written(search.seeds(search.bm25(docs, query, seeds)), "seeds")
    found = first.select("id", F.col("seed_score").alias("lexical"))
    parts = T.decompose(query)
    if len(parts) > 1:
        fused = tools.sub_query_scores(tools.searched(docs.select("id", "title", "content"), parts, seeds))
        found = found.union(fused.select("id", F.col("score").alias("lexical"))).groupBy("id").agg(F.max("lexical").alias("lexical"))
    slim = docs.select("id", "category", F.length("content").alias("n"))
    labels = docs.select(F.col("category").alias("id"), F.col("category").alias("title")).where("title is not null").distinct()
    named = [r.title for r in expand.category_anchors(labels, query).where("way = 0").orderBy("title").limit(siblings).collect()]
    near = found.join(slim, "id").groupBy("category").agg(F.max("lexical").alias("anchor"))
    more = search.longest_by_category(slim.join(F.broadcast(near), "category"), siblings)  # near holds a few times `seeds` rows
    held = found.select("id", "lexical", F.lit(1.0).alias("graph"), F.lit("").alias("reason"), F.lit("").alias("origin"))
    more = more.select("id", F.lit(0.0).alias("lexical"), (F.col("anchor") * 0.5).alias("graph"), F.lit("category_sibling").alias("reason"), F.lit("").alias("origin"))
    lists = [held, more]
    if edges is not None:
        cited = edges.where("kind = 'references'").join(F.broadcast(found.select(F.col("id").alias("source_id"))), "source_id")
        lists.insert(1, cited.select(F.col("target_id").alias("id"), F.lit(0.0).alias("lexical"), F.lit(0.9).alias("graph"), F.lit("references").alias("reason"), F.col("source_id").cast("string").alias("origin")))
    every = None
    for i, part in enumerate(lists):
        part = part.withColumn("path", F.lit(i))
        every = part if every is None else every.union(part)
    once = Window.partitionBy("id").orderBy("path", F.col("graph").desc(), "origin")
    every = every.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    both = docs.join(F.broadcast(every.drop("_n", "path")), "id")  # a few hundred rows
    words = F.array_distinct(word_list(F.lower(F.coalesce("content", F.lit("")))))
    asked = F.array(*[F.lit(w) for w in dict.fromkeys(query.lower().split())])
    both = both.select(F.lit(0).alias("query_id"), "id", F.col("id").alias("doc_id"), "lexical", "graph", "reason", F.col("origin").alias("anchor"), F.coalesce("category", F.lit("")).alias("category"), words.alias("words"))
    both = both.withColumn("semantic", jaccard(F.col("words"), asked)).withColumn("structural", F.lit(0.0))
    ranked = search.rerank(both).join(both.select("id", "words", "reason", "anchor", "category"), "id")
    return choose(ranked, k, categories=named)

"""Edges found in texts: references by key, rules between titles and tags, connectives; the index of chunks and entities; duplicates."""

from __future__ import annotations

import difflib
import itertools
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom import plugins
from graphloom.functions.expressions import cosine

EDGE = ["source_id", "target_id", "kind", "weight"]
#: What stands between a named thing and what follows from it, by kind of edge.
CONNECTIVES = {
    "depends_on": [r"에 (?:따라|의거하여|의거해|근거하여|근거해)", r"을(?:를)? 준용"],
    "caused": [r"(?:으로|로) 인(?:해|하여)", " 때문에", r"의 결과(?:로)?", "에 기인"],
    "supersedes": [r"을(?:를)? (?:개정|대체하여|폐지하고|갈음)"],
    "contradicts": [r"(?:와|과) 달리", r"에 반(?:하여|해)", r"(?:와|과) 배치"],
}


def key_collisions(nodes: DataFrame, key: str, scope: str | None = None) -> float:
    """The share of keyed nodes that repeat a key of their scope: where it is large, references by key say little."""
    held = nodes.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(*([scope] if scope else []), key).agg(F.count("*").alias("n"))
    n, extra = held.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()
    return extra / n if n else 0.0


def reference_links(nodes: DataFrame, key: str, token: str, scope: str | None = None, cross: str | None = None, most: float = 0.1) -> DataFrame:
    """REFERENCES edges from the nodes (id, content, key, scope) that cite a key to the one node that has it.

    token is a pattern of what keys look like; what it finds is joined with the keys, in the citing node's scope.
    cross is a pattern of two groups, scope and key, for citations that name their scope; a bare key inside one
    is not read again. Ambiguous keys and self-references give none, and no edge comes of a table of keys that collide.
    """
    spark = nodes.sparkSession
    if key_collisions(nodes, key, scope) > most:
        return spark.createDataFrame([], "source_id string, target_id string, kind string, weight double")
    where = F.coalesce(F.col(scope).cast("string"), F.lit("")) if scope else F.lit("")
    n = nodes.select("id", F.coalesce("content", F.lit("")).alias("content"), where.alias("scope"), F.col(key).cast("string").alias("key"))
    target = n.where("key is not null and key <> ''").groupBy("scope", "key").agg(F.min("id").alias("target_id"), F.count("*").alias("n")).where("n = 1").drop("n")
    rest = F.regexp_replace("content", cross, " ") if cross else F.col("content")
    cited = n.select(F.col("id").alias("source_id"), "scope", F.explode(F.array_distinct(F.regexp_extract_all(rest, F.lit(token), F.lit(0)))).alias("key"))
    if cross:
        pairs = F.arrays_zip(F.regexp_extract_all("content", F.lit(cross), F.lit(1)).alias("scope"), F.regexp_extract_all("content", F.lit(cross), F.lit(2)).alias("key"))
        cited = cited.union(n.select(F.col("id").alias("source_id"), F.explode(pairs).alias("p")).select("source_id", "p.scope", "p.key"))
    found = cited.join(target, ["scope", "key"]).where("source_id <> target_id").select("source_id", "target_id").distinct()
    return found.select("source_id", "target_id", F.lit("references").alias("kind"), F.lit(1.0).alias("weight"))


def title_mentions(nodes: DataFrame, most_words: int = 6, least: int = 4) -> DataFrame:
    """Rows (source_id, target_id): nodes whose content holds another node's title as a run of whole words.

    Titles are looked up among the contents' runs of words, by join, not by trying each title on each text. A title of more
    than most_words words is looked up by its first ones, and what they find is read again for the whole title.
    """
    cut = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    titled = nodes.where(F.length(F.trim("title")) >= least).select(F.col("id").alias("target_id"), cut(F.col("title")).alias("t")).where(F.size("t") > 0)
    first = F.slice("t", 1, most_words)
    titled = titled.select("target_id", F.size(first).alias("n"), F.array_join(first, " ").alias("run"), F.when(F.size("t") > most_words, F.array_join("t", " ")).alias("whole"))
    sizes = [r.n for r in titled.select("n").distinct().collect()]  # at most most_words numbers
    w = nodes.select(F.col("id").alias("source_id"), cut(F.col("content")).alias("w"))

    def runs(n: int) -> Column:
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " ")))

    out = None
    for n in sorted(sizes):
        part = w.select("source_id", F.explode(runs(n)).alias("run"))
        out = part if out is None else out.union(part)
    if out is None:
        return nodes.sparkSession.createDataFrame([], f"source_id {dict(nodes.dtypes)['id']}, target_id {dict(nodes.dtypes)['id']}")
    found = out.join(titled.select("target_id", "run", "whole"), "run").where("source_id <> target_id").select("source_id", "target_id", "whole")
    if most_words not in sizes:
        return found.select("source_id", "target_id").distinct()
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    long = found.where("whole is not null").join(w.select("source_id", padded(F.array_join("w", " ")).alias("said")), "source_id")
    long = long.where(F.contains("said", padded(F.col("whole")))).select("source_id", "target_id")
    return found.where("whole is null").select("source_id", "target_id").union(long).distinct()


def _combined(values: Column, n: int) -> Column:
    """All choices of n of the sorted values, each as one string."""
    if n == 1:
        return F.transform(values, lambda x: x)
    return F.flatten(F.transform(values, lambda x, i: F.transform(_combined(F.slice(values, i + 2, F.size(values)), n - 1), lambda y: F.concat_ws("\x1f", x, y))))


def relations(nodes: DataFrame, most: int = 5, shared: int = 2, near: float = 0.75, vectors: DataFrame | None = None, detectors: tuple[str, ...] = ()) -> DataFrame:
    """Edges by rule, the heaviest `most` of a node: its content mentions a title (0.8; lessons learn from it, rules depend on
    concepts), tags are shared (0.5), vectors are near (0.7 of their cosine). The first rule that gives a target wins.

    nodes: (id, kind, title, content, tags). vectors: candidate pairs (source_id, target_id, similarity) of a vector search.
    detectors: names of plugins whose edges stand beside those by rule, of any number, with kinds and weights of their own.
    """
    kinds = nodes.select("id", "kind")
    said = title_mentions(nodes).join(kinds.select(F.col("id").alias("source_id"), F.col("kind").alias("a")), "source_id").join(kinds.select(F.col("id").alias("target_id"), F.col("kind").alias("b")), "target_id")
    kind = F.when(F.col("a") == "lesson", "learned_from").when((F.col("a") == "rule") & (F.col("b") == "concept"), "depends_on").otherwise("related")
    found = said.select("source_id", "target_id", kind.alias("kind"), F.lit(0.8).alias("weight"), F.lit(0).alias("rule"))
    # A choice of so many tags is the key, so one common tag makes no group. All targets of this rule weigh the same and go by
    # id, so of each key the smallest ids are enough, one more than a node keeps, as one of them may be the node itself.
    tag = nodes.select("id", F.array_sort(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>")))).alias("t")).where(F.size("t") >= shared)
    keyed = tag.select("id", F.explode(_combined(F.col("t"), shared)).alias("k"))
    smallest = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("k").orderBy("id"))).where(F.col("_n") <= most + 1).select("k", F.col("id").alias("target_id"))
    same = keyed.join(smallest, "k").where("id <> target_id").select(F.col("id").alias("source_id"), "target_id").distinct()
    found = found.union(same.select("source_id", "target_id", F.lit("related"), F.lit(0.5), F.lit(1)))
    if vectors is not None:
        close = vectors.where((F.col("similarity") >= near) & (F.col("source_id") != F.col("target_id")))
        close = close.join(tag.select(F.col("id").alias("source_id"), F.col("t").alias("a")), "source_id", "left").join(tag.select(F.col("id").alias("target_id"), F.col("t").alias("b")), "target_id", "left")
        # Pairs that share tags, too, are of that rule, also those that the smallest ids left out.
        both = F.coalesce(F.size(F.array_intersect("a", "b")) >= shared, F.lit(False))
        found = found.union(close.select("source_id", "target_id", F.lit("related"), F.when(both, 0.5).otherwise(F.col("similarity") * 0.7), F.when(both, 1).otherwise(2)))
    once = Window.partitionBy("source_id", "target_id").orderBy("rule")
    top = Window.partitionBy("source_id").orderBy(F.col("weight").desc(), "rule", "target_id")
    found = found.withColumn("_r", F.row_number().over(once)).where("_r = 1")
    found = found.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= most).select(*EDGE)
    own = plugins.detected(nodes, list(detectors))
    return found if own is None else found.union(own.select(*EDGE)).groupBy(*EDGE[:3]).agg(F.max("weight").alias("weight"))


def connective_links(chunks: DataFrame, titles: dict[str, str], window: int = 40, per_kind: int = 5) -> DataFrame:
    """Edges from chunks (id, title, content) to the named thing before a connective: of the titles in the window the longest, then the closest.

    titles maps lower-case names to ids and goes to all tasks: a dictionary of names with a bound of its own.
    """
    names = sorted((t for t in titles if 2 <= len(t) <= 40), key=lambda t: (-len(t), t))
    rules = [(kind, re.compile("|".join(p))) for kind, p in CONNECTIVES.items()]

    def links(text: str) -> Iterator[tuple[str, str]]:
        for kind, rule in rules:
            seen: list[str] = []
            for m in rule.finditer(text):
                before = text[max(0, m.start() - window) : m.start()]
                name = next((n for n in names if n in before), None)
                if name and titles[name] not in seen and len(seen) < per_kind:
                    seen.append(titles[name])
            yield from ((kind, t) for t in seen)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, t, kind, 0.7) for i, text in zip(b.id, b.text, strict=True) for kind, t in links(text.lower()) if t != i]
            yield pd.DataFrame(rows, columns=EDGE)

    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    return chunks.select("id", text.alias("text")).mapInPandas(each, "source_id string, target_id string, kind string, weight double")


def chunk_entities(edges: DataFrame) -> DataFrame:
    """The index (chunk_id, entity_id) of what chunks mention or were extracted from."""
    said = edges.where("kind in ('mentions', 'contains')").select(F.col("source_id").alias("chunk_id"), F.col("target_id").alias("entity_id"))
    taken = edges.where("kind = 'extracted_from'").select(F.col("target_id").alias("chunk_id"), F.col("source_id").alias("entity_id"))
    return said.union(taken).distinct()


def chunks_for_entities(index: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows (chunk_id, overlap) by how many of the entities (entity_id) a chunk has."""
    return index.join(entities.select("entity_id").distinct(), "entity_id", "left_semi").groupBy("chunk_id").agg(F.count_distinct("entity_id").alias("overlap"))


def shared_entities(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows (entity_id, n): entities in two or more of the chunks (chunk_id)."""
    held = index.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return held.groupBy("entity_id").agg(F.count_distinct("chunk_id").alias("n")).where("n >= 2")


def co_occurrence(index: DataFrame, a: str, b: str) -> DataFrame:
    """The chunks that have both entities."""
    both = index.where(F.col("entity_id").isin(a, b)).groupBy("chunk_id").agg(F.count_distinct("entity_id").alias("n"))
    return both.where("n = 2").select("chunk_id")


def duplicates(nodes: DataFrame, least: float = 0.85, limit: int | None = 50, vectors: str | None = None, vector_weight: float = 0.4, most_kept: int = 400) -> DataFrame:
    """Pairs (a, b, score) of nodes (id, kind, title) of one kind with like titles, or titles and vectors mixed.

    The likeness 2*M/(n+m) of two titles is at most twice the characters that both have, over their lengths. So a
    pair meets under its kind and a character count that it must agree in: titles are dealt out by the
    content of groups of letters, of which more are made than a pair that reaches the score may differ in.
    Matching runs stand in order, so a pair also has that many characters in common in order: where titles are so short
    that these can be listed, by what is left without the few others, that is what a pair meets under instead.
    Without vectors the smallest id stands for its title: other nodes of the title pair with it alone.
    """
    low = F.lower(F.coalesce("title", F.lit("")))
    n = nodes.select("id", "kind", low.alias("t"), *([F.col(vectors).cast("array<double>").alias("v")] if vectors else []))
    # A mixed score reaches its bound with a lower likeness of titles if the vectors are equal.
    floor = least if not vectors else (least - vector_weight) / (1 - vector_weight)

    titles = n.select("kind", "t").distinct()
    sizes = sorted(r.n for r in titles.select(F.length("t").alias("n")).distinct().collect())  # lengths of titles, a number each

    def common(x: int, y: int) -> int:
        """How many characters in order two titles of these lengths must have in common."""
        return math.ceil(floor * (x + y) / 2 - 1e-9)

    def listed(x: int, y: int) -> bool:
        k = common(x, y)
        return 0 < k <= min(x, y) and max(math.comb(x, x - k), math.comb(y, y - k)) <= most_kept

    # By length: lengths of titles that it may be like, with what they must share where that is listed, and whether others remain.
    partners = {x: [(y, common(x, y)) for y in sizes if floor > 0 and listed(x, y)] for x in sizes}
    rest = {x: floor <= 0 or any(common(x, y) <= min(x, y) and not listed(x, y) for y in sizes) for x in sizes}

    def groups(title: str) -> list[str]:
        """What is left of a title without some characters; and, for lengths where that is too much, contents of groups of
        characters: of D+1 groups one at least is the same in both where D characters differ."""
        size, level = len(title), 1.0
        out = [f"{min(size, y)}:{max(size, y)}|{v}" for y, k in partners.get(size, ()) for v in {"".join(c) for c in itertools.combinations(title, k)}]
        if not rest.get(size, True):
            return out
        # A pair belongs to the power of 1.2 below its shorter title; a title may be the shorter or the longer one.
        while level <= size:
            high = level * 1.2
            if floor * size / (2 - floor) < high:
                differ = int(2 * high * (1 - floor) / floor)
                parts: list[list[str]] = [[] for _ in range(differ + 1)]
                for c in sorted(title):
                    parts[ord(c) % (differ + 1)].append(c)
                out += [f"{level:.3f}|{i}|{''.join(p)}" for i, p in enumerate(parts)]
            level = high
        return out

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, t, g) for k, t in zip(b.kind, b.t, strict=True) for g in groups(t)]
            yield pd.DataFrame(rows, columns=["kind", "t", "g"])

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(title_score=[difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(b.x, b.y, strict=True)])

    keys = titles.mapInPandas(blocks, "kind string, t string, g string")
    pairs = keys.alias("p").join(keys.alias("q"), (F.col("p.kind") == F.col("q.kind")) & (F.col("p.g") == F.col("q.g")) & (F.col("p.t") < F.col("q.t"))).select(F.col("p.kind").alias("kind"), F.col("p.t").alias("x"), F.col("q.t").alias("y")).distinct()
    bound = 2.0 * F.least(F.length("x"), F.length("y")) / (F.length("x") + F.length("y"))
    pairs = pairs.where(bound >= floor).mapInPandas(scored, "kind string, x string, y string, title_score double").where(F.col("title_score") >= floor)
    if not vectors:
        # The smallest id stands for a title, so that a title that many nodes have gives each of them one pair.
        first = n.groupBy("kind", "t").agg(F.min("id").alias("first"))
        out = pairs.join(first.select("kind", F.col("t").alias("x"), F.col("first").alias("a")), ["kind", "x"]).join(first.select("kind", F.col("t").alias("y"), F.col("first").alias("b")), ["kind", "y"]).select("a", "b", F.col("title_score").alias("score"))
        out = out.union(n.join(first, ["kind", "t"]).where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score")))
    else:
        same = titles.select("kind", F.col("t").alias("x"), F.col("t").alias("y"), F.lit(1.0).alias("title_score"))
        a = n.select("kind", F.col("t").alias("x"), F.col("id").alias("a"), F.col("v").alias("va"))
        b = n.select("kind", F.col("t").alias("y"), F.col("id").alias("b"), F.col("v").alias("vb"))
        near = cosine(F.coalesce("va", F.array().cast("array<double>")), F.coalesce("vb", F.array().cast("array<double>")))
        out = pairs.union(same).join(a, ["kind", "x"]).join(b, ["kind", "y"]).where("a <> b and (x <> y or a < b)").withColumn("near", near)
        mixed = F.when(F.col("near") > 0, (1 - vector_weight) * F.col("title_score") + vector_weight * F.col("near")).otherwise(F.col("title_score"))
        out = out.select("a", "b", mixed.alias("score"))
    out = out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").where(F.col("score") >= least)
    return out if limit is None else out.orderBy(F.col("score").desc(), "a", "b").limit(limit)


def resolutions(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (old, new): of the nodes that pairs (a, b) link, all merge into the one of most accesses, then of the smallest id."""
    from graphloom.operators.graph import linked

    group = linked(pairs)
    ranked = group.join(nodes.select("id", F.coalesce("access_count", F.lit(0)).alias("access_count")), "id")
    first = Window.partitionBy("label").orderBy(F.col("access_count").desc(), "id")
    named = ranked.withColumn("new", F.first("id").over(first))
    return named.where("id <> new").select(F.col("id").alias("old"), "new")


def phrase_hubs(docs: DataFrame, locale: str = "en", most: int = 15, extractors: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (doc_id, phrase) by the language's rules, or by the extractors named, the longest first."""
    rows = plugins.phrases(docs, list(extractors) or [locale])
    order = Window.partitionBy("doc_id").orderBy(F.length("phrase").desc(), "phrase")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def like(nodes: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Nodes whose title or content holds one of the query's words, the newest first."""
    test: Column = F.lit(False)
    for w in query.lower().split():
        test = test | F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(w)) | F.contains(F.lower(F.coalesce("content", F.lit(""))), F.lit(w))
    return nodes.where(test).orderBy(F.col("updated_at").desc(), "id").limit(limit)

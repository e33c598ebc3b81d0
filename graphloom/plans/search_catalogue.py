"""Search operators over the test tables, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.facade import as_nodes
from graphloom.operators import documents, evidence, expand, linking, retrieval, tools
from graphloom.operators.lineage import written
from graphloom.plans.registry import query, rounded
from graphloom.plans.text_catalogue import CHUNKS

NOW = 1_710_000_000.0


def _docs(t) -> DataFrame:
    """Documents as nodes: one line as title, source as category, language as tag."""
    return t("documents").select(
        F.col("doc_id").alias("id"), F.lit("chunk").alias("kind"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"), F.array("lang").alias("tags"),
        F.create_map(F.lit("category"), F.col("source")).alias("properties"), (F.lit(NOW) - F.col("doc_id") * 3600.0).alias("updated_at"),
        F.lit(0.5).alias("vitality"), F.lit(0).alias("success_count"), F.lit(0).alias("failure_count"), F.lit(0).alias("access_count"),
    )


@query("""with c as (select distinct source as title from documents where source is not null), w as (select title, case when contains('reports of src1 and src12 src', title) then 0 when contains(title, 'src') then 1 end as way from c)
select 'cat_' || substr(md5(title), 1, 16) as id, title, way from w where way is not null""")
def category_anchors(t):
    cats = documents.document_nodes(t("documents")).where("kind = 'concept'").select("id", "title")
    return expand.category_anchors(cats, "reports of src1 and src12 src")


def _graph(t) -> tuple[DataFrame, DataFrame]:
    d = t("documents")
    parts = documents.chunks(d)
    chunk = parts.select(documents.chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("id"), F.lit("chunk").alias("kind"))
    nodes = documents.document_nodes(d).select("id", "kind").union(chunk)
    return nodes, documents.part_of_edges(d).union(documents.chunk_edges(parts))


DOC, CHUNK, CAT = "'doc_' || substr(md5(doc_id::varchar), 1, 16)", "'chunk_' || substr(md5(doc_id || '->' || chunk_index), 1, 16)", "'cat_' || substr(md5(source), 1, 16)"


@query(f"""{CHUNKS}, e as (select {DOC} as a, {CAT} as b, 'part_of' as kind from documents where source is not null union all select {DOC}, {CHUNK}, 'contains' from c
  union all select {CHUNK}, 'chunk_' || substr(md5(doc_id || '->' || (chunk_index + 1)), 1, 16), 'next_chunk' from c where (doc_id, chunk_index + 1) in (select (doc_id, chunk_index) from c)),
x as (select a, b, kind from e union select b, a, kind from e),
sd as (select {DOC} as anchor, doc_id as rank, false as chunk from documents where doc_id in (0, 1) union all select {CHUNK}, 10 + chunk_index, true from c where doc_id = 2 and chunk_index < 2),
g as (select distinct {CAT} as anchor from documents where doc_id = 0),
p as (select anchor as id, 0 as path, 'seed' as reason, rank, null as anchor from sd
  union all select id, 2, 'category_sibling', 0, anchor from (select b as id, anchor, row_number() over (partition by anchor order by b) as n from g join (select distinct a, b from x) on a = anchor) where n <= 10
  union all select id, 3, 'document_chunk', rank, anchor from (select b as id, rank, anchor, row_number() over (partition by anchor order by b) as n from sd join (select distinct a, b from x where kind in ('contains', 'part_of')) on a = anchor) where n <= 20
  union all select b, 4, 'chunk_next', rank, anchor from sd join (select distinct a, b from x where kind = 'next_chunk') on a = anchor where chunk),
o as (select *, row_number() over (partition by id order by path, rank, anchor nulls first) as n from p)
select id, reason, (path > 0)::int as hops, anchor from (select * from o where n = 1 order by path, rank, anchor nulls first, id limit 100)""")
def expand_graph(t):
    nodes, edges = _graph(t)
    docs = t("documents").where("doc_id in (0, 1)").select(documents.short_id("doc_", F.col("doc_id")).alias("id"), F.col("doc_id").alias("rank"))
    chunks = documents.chunks(t("documents").where("doc_id = 2")).where("chunk_index < 2").select(documents.chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("id"), (F.col("chunk_index") + 10).cast("long").alias("rank"))
    cats = t("documents").where("doc_id = 0").select(documents.short_id("cat_", F.col("source")).alias("id"))
    return expand.expand(nodes.withColumn("kind", F.when(F.col("id").startswith("doc_"), "document").otherwise(F.col("kind"))), edges, docs.union(chunks), cats)


@query("""with d as (select doc_id as id, lower(trim(split_part(text, chr(10), 1), ' ')) as t, lower(trim(substr(text, 1, 200), ' ')) as h, doc_id % 7 as u from documents where text is not null)
select id from d qualify row_number() over (partition by t, h, case when length(t) < 4 then id end order by u desc, id) = 1""")
def supersede(t):
    d = _docs(t).where("content is not null").withColumn("updated_at", (F.col("id") % 7).cast("double"))
    return tools.supersede(d).select("id")


@query("""with x as (select doc_id as id, 0.9::double as score, 'fts' as reason, 0 as l from documents where doc_id % 3 = 0 union all select doc_id, 0.08, 'vector', 1 from documents where doc_id % 2 = 0 union all select doc_id, 0.06, 'feedback', 2 from documents where doc_id % 5 = 0)
select id, score, reason from x qualify row_number() over (partition by id order by l) = 1""")
def seed_union(t):
    d = t("documents")
    part = lambda n, score, reason: d.where(F.col("doc_id") % n == 0).select(F.col("doc_id").alias("id"), F.lit(score).alias("score"), F.lit(reason).alias("reason"))
    return tools.seed_union([part(3, 0.9, "fts"), part(2, 0.08, "vector"), part(5, 0.06, "feedback")])


@query("""with l as (select doc_id as id, 0 as list, doc_id // 3 as rank from documents where doc_id % 3 = 0 union all select doc_id, 1, doc_id // 2 from documents where doc_id % 2 = 0),
m as (select id, list, rank from l qualify row_number() over (partition by id order by list, rank) = 1) select id, list, rank from m order by list, rank, id limit 10""")
def compare_merge(t):
    d = t("documents")
    part = lambda n: d.where(F.col("doc_id") % n == 0).select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / n).alias("rank"))
    return tools.merged_lists([part(3), part(2)])


@query("""with l as (select doc_id as id, doc_id // 3 as rank from documents where doc_id % 3 = 0 union all select doc_id, doc_id // 2 from documents where doc_id % 2 = 0), f as (select id, sum(1.0::double / (60 + rank)) as s from l group by id)
select id, round(0.10 + 0.85 * s / (select max(s) from f), 9) as score from f""")
def sub_query_fusion(t):
    d = t("documents")
    part = lambda n: d.where(F.col("doc_id") % n == 0).select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / n).alias("rank"))
    return tools.sub_query_scores([part(3), part(2)]).select("id", rounded("score", places=9))


@query("""with a as (select doc_id as id from documents where doc_id % 3 = 0), b as (select doc_id as id from documents where doc_id % 2 = 0), c as (select doc_id as id from documents where doc_id % 5 = 0),
u as (select id, 0.8::double as s, 0 as l from a union all select id, 0.6, 1 from b union all select id, 0.7, 2 from c)
select id, round(least(1.0, arg_min(s, l) + 0.2 * (count(*) - 1)), 6) as score from u group by id order by score desc, id limit 20""")
def hybrid_search(t):
    d = t("documents")
    part = lambda n: d.where(F.col("doc_id") % n == 0).select(F.col("doc_id").alias("id"))
    return tools.hybrid(part(3), part(2), part(5)).select("id", rounded("score"))


@query("select doc_id as id from documents where doc_id % 3 = 0 and doc_id % 2 <> 0")
def exclude_seen(t):
    d = t("documents").select(F.col("doc_id").alias("id"))
    return tools.exclude_seen(d.where("id % 3 = 0"), d.where("id % 2 = 0"))


@query("""select doc_id as id from documents where contains(lower(text), 'thereon') or contains(lower(text), 'license') order by doc_id limit 25""")
def like_search(t):
    return linking.like(_docs(t), "license thereon", 25).select("id")


@query("""with a as (select doc_id as id, (doc_id % 10) / 10.0::double as s from documents), b as (select doc_id as id, (doc_id % 7) / 7.0::double as r from documents where doc_id % 4 = 0)
select a.id, round(case when r is null then s else 0.7 * s + 0.3 * r end, 6) as score from a left join b on a.id = b.id""")
def rerank_blend(t):
    d = t("documents").select(F.col("doc_id").alias("id"))
    return tools.blended(d.withColumn("score", (F.col("id") % 10) / 10.0), d.where("id % 4 = 0").withColumn("score", (F.col("id") % 7) / 7.0)).select("id", rounded("score"))


INTENT_NODES = "n as (select doc_id as id, case doc_id % 3 when 0 then 'decision' when 1 then 'outcome' else 'lesson' end as kind from documents)"


@query(f"""with {INTENT_NODES}, e as (select id as a, id + 1 as b from n where kind = 'decision' and id + 1 in (select id from n)), h as (select id, 0.9::double as r from n where id < 12 and kind = 'decision'),
x as (select id, r from h union all select b, max(r) * 0.7 from e join h on a = id group by b)
select id, kind, round(r, 6) as relevance from x join n using (id)""")
def similar_decisions(t):
    nodes = _docs(t).withColumn("kind", F.when(F.col("id") % 3 == 0, "decision").when(F.col("id") % 3 == 1, "outcome").otherwise("lesson"))
    to = nodes.select((F.col("id") - 1).alias("id"))
    edges = nodes.where("kind = 'decision'").join(to, "id", "left_semi").select(F.col("id").alias("source_id"), (F.col("id") + 1).alias("target_id"), F.lit("resulted_in").alias("kind"), F.lit(1.0).alias("weight"))
    hits = nodes.where("id < 12 and kind = 'decision'").select("id", F.lit(0.9).alias("score"))
    return tools.by_intent(hits, nodes, edges, "similar_decisions", NOW, 1000).select("id", "kind", rounded("relevance"))


@query()
def fuzzy_topk(t):
    d = t("documents").select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"))
    return evidence.fuzzy(d, "licence thereon").select("id", rounded("score"))


@query()
def evidence_search(t):
    d = _docs(t).withColumn("category", F.try_element_at("properties", F.lit("category")))
    return evidence.evidence(d, "license thereon")


@query()
def whole_evidence_search(t):
    """All stages: documents and their categories as one graph, a vector for some documents, and the rank around the seeds."""
    vectors = t("embeddings").select(F.col("vec_id").alias("id"), "embedding").hint("merge")  # they grow, so they are not broadcast
    docs = written(as_nodes(_docs(t).join(vectors, "id", "left").withColumn("id", F.concat(F.lit("doc:"), "id")), NOW), "nodes")
    label = F.try_element_at("properties", F.lit("category"))
    named = docs.where(label.isNotNull()).select("id", label.alias("title"))
    cats = named.select("title").distinct().select(documents.short_id("cat_", F.col("title")).alias("id"), F.lit("concept").alias("kind"), "title")
    nodes = docs.unionByName(written(as_nodes(cats, NOW), "nodes"))
    edges = named.select(F.col("id").alias("source_id"), documents.short_id("cat_", F.col("title")).alias("target_id"), F.lit("part_of").alias("kind"), F.lit(0.7).alias("weight"))
    edges = written(edges, "edges")
    asked = [0.1 * (i % 7 - 3) for i in range(64)]
    return retrieval.find(nodes, edges, "src7 license thereon", 2024, 10, vector=asked).select("id", "rank", rounded("total"), "reason", "anchor")


@query()
def legacy_search(t):
    return tools.legacy(_docs(t), "license thereon", NOW).select("id", rounded("relevance"), rounded("resonance"))


@query()
def dual_level_search(t):
    return tools.dual_level(_docs(t), "license thereon", NOW, "low").select("id", rounded("score"))


@query()
def deep_search(t):
    nodes = _docs(t).withColumn("id", F.concat(F.lit("doc:"), "id"))
    edges = nodes.select(F.col("id").alias("source_id"), F.try_element_at("properties", F.lit("category")).alias("target_id"), F.lit("part_of").alias("kind"))
    return tools.deep_search(nodes, edges, "license thereon").select("part", "id")


@query()
def duplicate_titles(t):
    s = t("supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"), F.lit("entity").alias("kind"), F.col("s_name").alias("title"))
    return linking.duplicates(s, 0.9, limit=50).select("a", "b", rounded("score"))

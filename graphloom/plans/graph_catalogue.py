"""Graph operators over all test tables, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import documents, export, graph, lifecycle, linking, sessions
from graphloom.operators.ingest import Table, ingest_tables
from graphloom.plans.catalogue import EDGES, NOW, key_graph
from graphloom.plans.registry import query, rounded

#: Key and foreign keys of the test tables; lineitem has no key, and repeats order and line number.
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": None}
FOREIGN = {
    "nation": {"n_regionkey": ("region", "r_regionkey")}, "customer": {"c_nationkey": ("nation", "n_nationkey")}, "supplier": {"s_nationkey": ("nation", "n_nationkey")},
    "orders": {"o_custkey": ("customer", "c_custkey")}, "lineitem": {"l_orderkey": ("orders", "o_orderkey"), "l_partkey": ("part", "p_partkey"), "l_suppkey": ("supplier", "s_suppkey")},
}
LINE = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice".split()


def schema(t, names: list[str] | None = None) -> list[Table]:
    return [Table(n, t(n), KEYS[n], FOREIGN.get(n, {})) for n in names or KEYS]


def whole_graph(t) -> tuple[DataFrame, DataFrame]:
    """All rows as nodes by their key, those of lineitem by several columns that together tell its rows apart."""
    line = t("lineitem").select(F.concat_ws("-", *[F.col(c).cast("string") for c in LINE[:4]], F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"), F.date_format("l_shipdate", "yyyyMMdd")).alias("line_id"), *LINE[:6])
    tables = [*schema(t, [n for n in KEYS if n != "lineitem"]), Table("lineitem", line, "line_id", FOREIGN["lineitem"])]
    return ingest_tables(tables)


LINE_ID = "concat_ws('-', l_orderkey::varchar, l_partkey::varchar, l_suppkey::varchar, l_linenumber::varchar, round(l_extendedprice * 100)::bigint::varchar, strftime(l_shipdate, '%Y%m%d'))"
NODES = f"""n as (select 'region:' || r_regionkey as id, 'region:' || r_regionkey as title from region union all select 'nation:' || n_nationkey, 'nation:' || n_nationkey from nation
  union all select 'customer:' || c_custkey, 'customer:' || c_custkey from customer union all select 'supplier:' || s_suppkey, 'supplier:' || s_suppkey from supplier
  union all select 'part:' || p_partkey, 'part:' || p_partkey from part union all select 'orders:' || o_orderkey, 'orders:' || o_orderkey from orders
  union all select 'lineitem:' || {LINE_ID}, 'lineitem:' || {LINE_ID} from lineitem)"""
ALL_EDGES = f"""a as (select * from e union all select 'orders:' || o_orderkey, 'customer:' || o_custkey, 'related', 0.8 from orders union all select 'lineitem:' || {LINE_ID}, 'orders:' || l_orderkey, 'related', 0.8 from lineitem
  union all select 'lineitem:' || {LINE_ID}, 'part:' || l_partkey, 'related', 0.8 from lineitem union all select 'lineitem:' || {LINE_ID}, 'supplier:' || l_suppkey, 'related', 0.8 from lineitem)"""


@query(f"with {NODES} select id, 'entity' as kind, title, split_part(id, ':', 1) as table_name from n")
def nodes_from_tables(t):
    return whole_graph(t)[0].select("id", "kind", "title", F.try_element_at("properties", F.lit("_table_name")).alias("table_name"))


@query(f"with {EDGES}, {ALL_EDGES} select * from a")
def fk_edges(t):
    return whole_graph(t)[1]


@query(f"with {NODES} select 'entity' as kind, count(*) as n from n")
def node_stats(t):
    return graph.node_stats(whole_graph(t)[0])


@query(f"with {EDGES}, {ALL_EDGES}, {NODES} select 'node' as what, 'entity' as name, count(*) as n from n union all select 'edge', kind, count(*) from a group by kind")
def graph_stats(t):
    return graph.graph_stats(*whole_graph(t))


@query("select 'part:' || p_partkey as id, concat_ws(' | ', p_name, p_brand, p_type) as told from part")
def row_values(t):
    from graphloom.operators.ingest import row_content

    told = F.regexp_replace(row_content(t("part").select("p_name", "p_brand", "p_type"), "part", {"p_name": 0, "p_brand": 1, "p_type": 2}), "^part: ", "")
    return t("part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), told.alias("told"))


@query("""select 'l_partkey' as a, 'l_suppkey' as b""")
def bridge_detection(t):
    found = graph.bridge_columns(["l_linenumber", "l_partkey", "l_suppkey", "l_tax"], "l_linenumber", ["l_partkey", "l_suppkey"])
    return t("region").limit(1).select(F.lit(found[0]).alias("a"), F.lit(found[1]).alias("b"))


def _rank_sql(edges: str, seeds: str, rounds: int) -> str:
    """The rank's rounds one after another: seeds (id, weight), edges e (source_id, target_id, w)."""
    out = f"""{edges}, p as (select id, weight / sum(weight) over () as p0 from ({seeds})),
done as (select id from p union select target_id from e join p on source_id = id union select source_id from e join p on target_id = id),
c as (select source_id, target_id, w * ((source_id in (select id from done))::int + (target_id in (select id from done))::int) as w from e),
b as (select source_id as a, target_id as b, w from c where w > 0 union all select target_id, source_id, w from c where w > 0),
g as (select a, b, sum(w) as w from b group by all), st as (select a, b, w / sum(w) over (partition by a) as p from g), r0 as (select id, p0 as r from p)"""
    for i in range(1, rounds + 1):
        out += f""",
m{i} as (select b as id, sum(r * p) as m from r{i - 1} join st on a = id group by b), r{i} as (select id, 0.15::double * coalesce(p0, 0) + 0.85::double * coalesce(m, 0) as r from p full join m{i} using (id))"""
    return f"with {out} select id, round(r, 9) as score from r{rounds} order by score desc, id limit 20"


@query(_rank_sql(f"{EDGES.replace('e as (', 'e0 as (', 1).replace('from e union select target_id, source_id from e)', 'from e0 union select target_id, source_id from e0)')}, e as (select source_id, target_id, weight * 0.4::double as w from e0)", "select 'nation:3' as id, 1.0::double as weight", 5))
def ppr_topk(t):
    seeds = t("region").limit(1).select(F.lit("nation:3").alias("id"), F.lit(1.0).alias("weight"))
    ranked = graph.personalized_rank(key_graph(t), seeds, rounds=5)
    return ranked.select("id", F.round("score", 9).alias("score")).orderBy(F.col("score").desc(), "id").limit(20)


@query(_rank_sql("e as (select 'doc:' || doc_id as source_id, 'source:' || source as target_id, 0.7::double as w from documents where source is not null)", "select 'doc:' || doc_id as id, 1.5::double as weight from documents where doc_id in (0, 1)", 5))
def ppr_v2_topk(t):
    d = t("documents")
    docs = d.select(F.concat(F.lit("doc:"), "doc_id").alias("id"), F.lit("chunk").alias("kind"))
    e = d.select(F.concat(F.lit("doc:"), "doc_id").alias("source_id"), F.concat(F.lit("source:"), "source").alias("target_id"), F.lit("part_of").alias("kind"), F.lit(1.0).alias("weight"))
    seeds = docs.where("id in ('doc:0', 'doc:1')").select("id", F.lit(1.0).alias("weight"))
    ranked = graph.chunk_rank(e.where("target_id is not null"), seeds, docs, rounds=5)
    return ranked.select("id", F.round("score", 9).alias("score")).orderBy(F.col("score").desc(), "id").limit(20)


def _label_sql(rounds: int) -> str:
    out = f"with {EDGES}, w as (select a, b, round(sum(weight), 9) as w from (select source_id as a, target_id as b, weight from e union all select target_id, source_id, weight from e) group by all), l0 as (select distinct a as id, a as label from w)"
    for i in range(1, rounds + 1):
        out += f", v{i} as (select a, label, round(sum(w), 9) as v from w join l{i - 1} on b = id group by all), l{i} as (select a as id, min(label) as label from v{i} where v = (select max(v) from v{i} x where x.a = v{i}.a) group by a)"
    return out + f" select id, label from l{rounds}"


@query(_label_sql(4))
def communities(t):
    return graph.communities(key_graph(t), 4)


@query(_label_sql(4).replace("select id, label from l4", "select 'community_' || substr(md5(label), 1, 16) as id, count(*) as n from l4 group by label having count(*) >= 3"))
def community_members(t):
    labels = graph.communities(key_graph(t), 4)
    _, edges = graph.community_nodes(labels, labels.select("id", F.col("id").alias("title")))
    return edges.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n"))


@query("""with p as (select o_custkey % 50 as a, o_custkey % 50 + case when o_custkey % 3 = 0 then 50 else 100 end as b from orders where o_custkey % 50 <> 7),
x as (select a, b from p union select b, a from p)
select a as id, least(a, min(b)) as label from x group by a""")
def linked_pairs(t):
    o = t("orders").where("o_custkey % 50 <> 7")
    pairs = o.select((F.col("o_custkey") % 50).alias("a"), (F.col("o_custkey") % 50 + F.when(F.col("o_custkey") % 3 == 0, 50).otherwise(100)).alias("b"))
    return graph.linked(pairs).select("id", "label")


MENTIONS = "m as (select distinct 'doc:' || doc_id as chunk_id, lower(unnest(regexp_extract_all(text, '[A-Z][a-z]{4,}'))) as entity_id from documents)"


def _index(t) -> DataFrame:
    found = documents.phrases(t("documents"))
    edges = found.select(F.concat(F.lit("doc:"), "doc_id").alias("source_id"), F.col("phrase").alias("target_id"), F.lit("mentions").alias("kind"))
    return linking.chunk_entities(edges)


@query(f"with {MENTIONS} select chunk_id, count(*) as overlap from m where entity_id in (select entity_id from m where chunk_id = 'doc:0') group by 1")
def chunks_for_entities(t):
    index = _index(t)
    return linking.chunks_for_entities(index, index.where("chunk_id = 'doc:0'"))


@query(f"with {MENTIONS} select entity_id, count(*) as n from m where chunk_id in (select 'doc:' || doc_id from documents where doc_id < 60) group by 1 having count(*) >= 2")
def shared_entities(t):
    chunks = t("documents").where("doc_id < 60").select(F.concat(F.lit("doc:"), "doc_id").alias("chunk_id"))
    return linking.shared_entities(_index(t), chunks)


@query(f"with {MENTIONS} select chunk_id from m where entity_id in ('license', 'apache') group by 1 having count(*) = 2")
def entity_co_occurrence(t):
    return linking.co_occurrence(_index(t), "license", "apache")


@query("""with c as (select distinct p_brand as key from part), r as (select 'part:' || p_partkey as id, p_brand as key, p_name || ' replaces Brand#' || (p_partkey % 60) as content from part where p_partkey < 2000),
b as (select key, min('brand:' || key) as target_id from c group by key)
select id as source_id, target_id, 'references' as kind, 1.0::double as weight from r join b on b.key = regexp_extract(content, 'Brand#[0-9]+')""")
def reference_links(t):
    p = t("part").where("p_partkey < 2000")
    brands = t("part").select(F.concat(F.lit("brand:"), "p_brand").alias("id"), F.lit("").alias("content"), F.col("p_brand").alias("key")).distinct()
    rows = p.select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.concat("p_name", F.lit(" replaces Brand#"), (F.col("p_partkey") % 60).cast("string")).alias("content"), F.lit(None).cast("string").alias("key"))
    return linking.reference_links(brands.union(rows), "key", "Brand#[0-9]+")


@query("""with n as (select 'nation:' || n_nationkey as id, 'concept' as kind, n_name as title, '' as content, [r_name] as tags from nation join region on n_regionkey = r_regionkey
  union all select 'note:' || c_custkey, case when c_custkey % 2 = 0 then 'lesson' else 'rule' end, 'n' || c_custkey % 10, 'about ' || lower(n_name) || ', again', []::varchar[] from customer join nation on c_nationkey = n_nationkey)
select a.id as source_id, b.id as target_id, case when a.kind = 'lesson' then 'learned_from' else 'depends_on' end as kind, 0.8::double as weight from n a join n b on a.content = 'about ' || lower(b.title) || ', again' and b.kind = 'concept' and length(b.title) >= 4""")
def relation_rules(t):
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"), F.lit("concept").alias("kind"), F.col("n_name").alias("title"), F.lit("").alias("content"), F.array("r_name").alias("tags"))
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    notes = c.select(F.concat(F.lit("note:"), "c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "lesson").otherwise("rule").alias("kind"), F.concat(F.lit("n"), (F.col("c_custkey") % 10).cast("string")).alias("title"), F.concat(F.lit("about "), F.lower("n_name"), F.lit(", again")).alias("content"), F.array().cast("array<string>").alias("tags"))
    return linking.relations(n.union(notes))


@query("""select 'session_' || conv_id as source_id, 'turn:' || conv_id || ':' || turn as target_id, 'contains' as kind, 1.0::double as weight from conversations where role = 'user'
union all select 'turn:' || conv_id || ':' || turn, 'turn:' || conv_id || ':' || n, 'followed_by', 1.0 from (select conv_id, turn, lead(turn) over (partition by conv_id order by turn) as n from conversations) where n is not null""")
def conversation_edges(t):
    return sessions.conversation(t("conversations"))[1]


@query("select distinct 'session_' || conv_id as id, 'session' as kind from conversations union all select 'turn:' || conv_id || ':' || turn, 'observation' from conversations")
def conversation_nodes(t):
    return sessions.conversation(t("conversations"))[0].select("id", "kind")


def _activity(t) -> DataFrame:
    e = t("events")
    kind = F.when(F.col("event_type") == "purchase", "decision").when(F.col("event_type") == "error", "outcome").when(F.col("event_type") == "signup", "observation").otherwise("tool_call")
    return e.select(F.concat(F.lit("user:"), F.col("user_id")).alias("session"), F.col("event_id").cast("double").alias("at"), kind.alias("kind"), F.concat(F.lit("e"), F.col("event_id")).alias("title"), F.col("props").alias("content"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("ref:"), (F.col("event_id") % 9).cast("string"))).alias("refers"))


@query("""with e as (select event_id, event_type from events) select kind, count(*) as n from (select 'part_of' as kind from events union all select 'depends_on' from e where event_type = 'purchase' and event_id % 2 = 0
  union all select 'resulted_in' from e where event_type = 'error' and event_id % 2 = 0 union all select 'produced' from e where event_type = 'signup' and event_id % 2 = 0
  union all select 'followed_by' from (select lead(event_id) over (partition by user_id order by event_id) as n from events) where n is not null) group by 1""")
def activity_edges(t):
    return sessions.activities(_activity(t))[1].groupBy("kind").agg(F.count("*").alias("n"))


@query("""select 'user:' || user_id as session, count(*) as calls, min(event_id)::double as first_at, max(event_id)::double as last_at, string_agg(distinct case event_type when 'purchase' then 'decision' when 'error' then 'outcome' when 'signup' then 'observation' else 'tool_call' end, ',' order by case event_type when 'purchase' then 'decision' when 'error' then 'outcome' when 'signup' then 'observation' else 'tool_call' end) as kinds from events group by 1""")
def session_info(t):
    return sessions.session_info(_activity(t))


def _counted(t) -> DataFrame:
    """Customers as nodes with counters."""
    c = t("customer")
    k = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("customer:"), k).alias("id"), F.lower("c_mktsegment").alias("kind"), F.col("c_name").alias("title"), F.concat(F.lit("balance "), F.round("c_acctbal").cast("long").cast("string")).alias("content"),
        F.array(F.col("c_mktsegment")).alias("tags"), (k % 4).cast("int").alias("level"), ((k % 5) / 5.0).alias("vitality"), (k % 13).alias("access_count"), (k % 11).alias("success_count"), (k % 3).alias("failure_count"), F.lit("").alias("source"), (F.lit(NOW) - k * 3600.0).alias("updated_at"),
    )


@query("""with n as (select 'customer:' || c_custkey as id, lower(c_mktsegment) as kind, c_name as title, c_custkey as k, 'balance ' || round(c_acctbal)::bigint as content, c_mktsegment as tag from customer)
select id, md5(case when row_number() over (partition by kind order by title, id) = 1 then '## ' || upper(kind[1]) || kind[2:] || chr(10) || chr(10) else '' end || '### ' || title || ' [' || tag || ']' || chr(10) || chr(10) || '- **Level**: ' || (k % 4) || chr(10) || '- **Vitality**: ' || printf('%.2f', (k % 5) / 5.0)
  || chr(10) || '- **Usage**: ' || (k % 13) || ' accesses, ' || (k % 11) || ' success, ' || (k % 3) || ' failure' || chr(10) || chr(10) || content || chr(10)) as line from n""")
def export_markdown(t):
    return export.markdown_lines(_counted(t)).select("id", F.md5("line").alias("line"))


@query(f"with {EDGES} select 'edge' as part, count(*) as n from e where source_id like 'customer:%' and false union all select 'node', count(*) from customer having count(*) > 0")
def export_json(t):
    n = _counted(t)
    rows = export.json_rows(n, key_graph(t)).groupBy("part").agg(F.count("*").alias("n"))
    parts = n.sparkSession.createDataFrame([("edge",), ("node",)], "part string")
    return parts.join(rows, "part", "left").select("part", F.coalesce("n", F.lit(0)).alias("n"))


@query("select doc_id::varchar as id, case when length(text) > 5000 then 'blob://' || doc_id else md5(text) end as content from documents where text is not null")
def blob_offload(t):
    d = t("documents").where("text is not null").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))
    kept, _ = export.offload(d, 5000)
    return kept.select("id", F.when(F.col("content").startswith("blob://"), F.col("content")).otherwise(F.md5("content")).alias("content"))


@query(f"""with a as (select c_custkey as k, 'customer:' || c_custkey as id, c_custkey % 4 as l0, c_custkey % 13 as seen, c_custkey % 11 + c_custkey % 3 as j, c_custkey % 11 as ok, c_custkey * 3600.0 as age from customer),
b as (select *, case when l0 = 0 and seen >= 3 then 1 when l0 = 0 and age > 259200 then -1 else l0 end as l1 from a), c as (select *, case when l1 = 1 and seen >= 10 then 2 when l1 = 1 and age > 7776000 then -1 else l1 end as l2 from b),
d as (select *, case when l2 = 2 and j >= 10 and ok >= 0.6 * j then 3 when l2 = 2 and age > 31536000 then -1 else l2 end as l3 from c), f as (select *, case when l3 = 3 and j >= 10 and ok < 0.6 * j then 2 else l3 end as level from d)
select id, level::int as level, round((k % 5) / 5.0 * 0.95, 6)::double as vitality from f where level <> -1""")
def maintain(t):
    kept, _, _ = lifecycle.maintain(_counted(t), key_graph(t), NOW)
    return kept.select("id", "level", rounded("vitality"))


@query("""with u as (select 'customer:' || o_custkey as id, count(*) as n from orders group by 1) select c.id, c.a + coalesce(u.n, 0) as access_count from (select 'customer:' || c_custkey as id, c_custkey % 13 as a from customer) c left join u on u.id = c.id""")
def access_tracking(t):
    return lifecycle.touch(_counted(t), t("orders").select(F.concat(F.lit("customer:"), "o_custkey").alias("id")), NOW).select("id", "access_count")


@query("select 'customer:' || c_custkey as id, true as vector, c_custkey % 2 = 0 as phrases from customer")
def backfill_needs(t):
    n = _counted(t).withColumn("embedding", F.array().cast("array<float>"))
    e = t("customer").where("c_custkey % 2 = 1").select(F.concat(F.lit("customer:"), "c_custkey").alias("source_id"), F.lit("x").alias("target_id"), F.lit("contains").alias("kind"))
    return lifecycle.needs_backfill(n, e)


@query("""with n as (select case when c_custkey % 4 = 1 then 'customer:' || (c_custkey - 1) else 'customer:' || c_custkey end as id, c_custkey as k from customer where c_custkey < 400)
select id, sum(k % 13)::bigint as access_count, round(max((k % 5) / 5.0), 6)::double as vitality, count(*) as parts from n group by 1""")
def merge_contents(t):
    n = _counted(t).where("cast(substring(id, 10) as long) < 400")
    k = F.substring("id", 10, 20).cast("long")
    same = n.where(k % 4 == 1).select(F.col("id").alias("old"), F.concat(F.lit("customer:"), k - 1).alias("new"))
    merged = graph.merge_contents(n, same)
    sized = n.join(same, n["id"] == same["old"], "left").groupBy(F.coalesce("new", "id").alias("id")).agg(F.count("*").alias("parts"))
    return merged.join(sized, "id").select("id", "access_count", rounded("vitality"), "parts")



"""Structured operators as whole tools, ingest, change capture, ontology and metadata over the test tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import changes, ingest, metadata, structured
from graphloom.operators.ontology import Ontology, Property, Rule, Type
from graphloom.plans.registry import query, rounded


def _page(sql: str, order: str, limit: int, offset: int) -> str:
    """SQL for one page of a result with its envelope."""
    return f"""with r as ({sql}), i as (select count(*) as total from r), x as (select *, greatest(0, least({limit}, total - {offset}))::int as showing from i)
select p.*, total, showing, {offset} as "offset", {offset} + showing < total as has_more, case when {offset} + showing < total then ({offset} + showing)::varchar end as next_cursor from (select * from r order by {order} limit {limit} offset {offset}) p, x"""


@query(_page("select o_orderkey from orders where o_totalprice > 200000", "o_orderkey", 20, 40))
def filter_envelope(t):
    rows = structured.filter_nodes(t("orders"), "o_totalprice", ">", 200000).select("o_orderkey")
    return structured.enveloped(rows, [F.col("o_orderkey")], 20, "40")


@query(_page("select o_custkey::varchar as \"group\", count(*)::double as value, 'customer:' || o_custkey as node_title from orders group by 1, 3", '"value" desc, "group"', 15, 5))
def aggregate_envelope(t):
    return structured.aggregate_nodes(t("orders"), "o_custkey", keys={"customer": "o_custkey"}, limit=15, cursor="5")


@query("select o_orderstatus as \"group\", round(avg(o_totalprice), 4) as value from orders where o_custkey in (1, 2, 3, 5, 8, 13) group by 1")
def aggregate_from_ids(t):
    out = structured.aggregate_nodes(t("orders"), "o_orderstatus", "avg", "o_totalprice", from_ids=["1", 2, 3, "5", 8, 13, "x"], id_col="o_custkey")
    return out.select("group", rounded("value", places=4))


@query(_page("select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_nationkey = 7)", "o_orderkey", 10, 10))
def join_related_envelope(t):
    people = t("customer").where("c_nationkey = 7").select(F.concat(F.lit("customer:"), "c_custkey").alias("v"))
    return structured.join_related(t("orders").select("o_orderkey", "o_custkey"), "o_custkey", people, [F.col("o_orderkey")], 10, "10").drop("o_custkey")


@query("""select 'customer:' || o_custkey as node_title, count(*)::double as value from orders group by 1""")
def agg_fk_title(t):
    orders = t("orders").withColumnRenamed("o_custkey", "c_custkey")
    return structured.aggregate_nodes(orders, "c_custkey", keys={"customer": "c_custkey", "orders": "o_orderkey"}).select("node_title", "value")


@query("select o_orderkey from orders where o_orderdate >= timestamp '1997-03-01' and o_orderdate < timestamp '1997-03-11'")
def filter_day_range(t):
    return structured.filter_nodes(t("orders"), "o_orderdate", "date_range", "1997-03-01..1997-03-10").select("o_orderkey")


def _nodes(t) -> DataFrame:
    """Parts with properties of age and weight, some of them no numbers."""
    k = F.col("p_partkey")
    pairs = [("category", F.col("p_brand")), ("year", (F.lit(1990) + k % 30).cast("string")), ("valid_from", F.when(k % 4 == 0, (F.lit(2000) + k % 30).cast("string"))), ("valid_to", F.when(k % 6 == 0, (F.lit(2010) + k % 30).cast("string"))), ("authority", F.when(k % 5 == 0, "n/a").otherwise((k % 9).cast("string")))]
    entries = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in pairs]), lambda e: e["value"].isNotNull())
    return t("part").select(F.concat(F.lit("part:"), k).alias("id"), F.lit("entity").alias("kind"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("content"), F.array("p_brand").alias("tags"), F.map_from_entries(entries).alias("properties"), (k % 100).cast("double").alias("updated_at"))


@query("select 'part:' || p_partkey as id from part where (p_partkey % 4 <> 0 or 2000 + p_partkey % 30 <= 2015) and (p_partkey % 6 <> 0 or 2010 + p_partkey % 30 >= 2015)")
def current_nodes(t):
    return _nodes(t).where(metadata.is_current(F.col("properties"), 2015)).select("id")


@query("select 'part:' || p_partkey as id, case when p_partkey % 5 = 0 then 0 else p_partkey % 9 end as authority from part order by 2 desc, p_partkey % 100 desc, 1 limit 30")
def authority_ranked(t):
    return metadata.authority_ranked(_nodes(t), 30).select("id", metadata.authority(F.col("properties")).alias("authority"))


@query("select 'part:' || p_partkey as id, case when length(p_name || ' ' || p_brand || ' ' || p_type) > 20 then substr(p_name || ' ' || p_brand || ' ' || p_type, 1, 20) || '…' else p_name || ' ' || p_brand || ' ' || p_type end as preview from part")
def node_summary(t):
    return metadata.summary(_nodes(t), 20).select("id", "preview")


@query("select count(*) as n from part where contains(lower(p_brand), 'brand#1') and 1990 + p_partkey % 30 = 2001")
def count_nodes(t):
    return structured.count_nodes(_nodes(t), "entity", "brand#1", "2001")


@query("select 'part:' || p_partkey as id from part order by p_partkey % 100 desc, 1 limit 12")
def node_scan(t):
    return structured.scan(_nodes(t), "entity", limit=12).select("id")


@query("select 'part:' || p_partkey as id from part where p_brand = 'Brand#13'")
def property_scan(t):
    return structured.by_property(_nodes(t), "category", "Brand#13").select("id")


ONTOLOGY = Ontology(
    [Type("thing", "", [Property("category", "str", True)]), Type("entity", "thing", [Property("authority", "int")]), Type("place", "thing"), Type("nation", "place"), Type("region", "place"), Type("person", "thing"), Type("customer", "person")],
    [Rule("related", ["person", "nation"], ["place"])],
)


@query("select 'part:' || p_partkey as id, 'authority is not int' as errors from part where p_partkey % 5 = 0")
def ontology_nodes(t):
    return ONTOLOGY.validate_nodes(_nodes(t))


@query("""select * from (values ('thing', 'thing'), ('entity', 'entity'), ('entity', 'thing'), ('place', 'place'), ('place', 'thing'), ('nation', 'nation'), ('nation', 'place'), ('nation', 'thing'), ('region', 'region'), ('region', 'place'), ('region', 'thing'),
('person', 'person'), ('person', 'thing'), ('customer', 'customer'), ('customer', 'person'), ('customer', 'thing')) v("type", ancestor)""")
def is_a_closure(t):
    return ONTOLOGY.closure(t("region").sparkSession)


@query("select 'supplier:' || s_suppkey as source_id, 'nation:' || s_nationkey as target_id, 'related' as kind, 'related: source supplier' as errors from supplier")
def ontology_edges(t):
    from graphloom.plans.catalogue import key_graph

    edges = key_graph(t)
    ids = edges.select(F.col("source_id").alias("id")).union(edges.select("target_id")).distinct()
    return ONTOLOGY.validate_edges(edges, ids.withColumn("kind", F.split("id", ":")[0]))


@query("select 'place' as kind, 'region:' || r_regionkey as id from region union all select 'place', 'nation:' || n_nationkey from nation")
def type_hierarchy(t):
    rows = t("region").select(F.concat(F.lit("region:"), "r_regionkey").alias("id"), F.lit("region").alias("kind")).union(t("nation").select(F.concat(F.lit("nation:"), "n_nationkey"), F.lit("nation"))).union(t("customer").select(F.concat(F.lit("customer:"), "c_custkey"), F.lit("customer")))
    return ONTOLOGY.of_type(rows, "place").select(F.lit("place").alias("kind"), "id")


@query("select c_custkey, case when c_acctbal = floor(c_acctbal) then floor(c_acctbal)::bigint::varchar else 'other' end as pk, c_custkey::varchar as same from customer")
def canonical_keys(t):
    c = t("customer")
    key = ingest.canonical(F.col("c_acctbal"), c.schema["c_acctbal"].dataType)
    return c.select("c_custkey", F.when(key.contains("."), "other").otherwise(key).alias("pk"), ingest.canonical(F.col("c_custkey").cast("double"), c.select(F.col("c_custkey").cast("double").alias("x")).schema["x"].dataType).alias("same"))


@query("select 'customer:' || c_name as title, c_custkey from customer")
def row_title(t):
    c = t("customer").select(F.col("c_name").alias("name"), "c_custkey")
    return c.select(ingest.row_title(c, "customer", "c_custkey").alias("title"), "c_custkey")


@query("select o_orderkey, o_totalprice > 0 as priced, o_orderpriority as rank from orders")
def cast_row(t):
    o = t("orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    m = ingest.cast_row(o, {"o_orderkey": "int", "o_totalprice": "float", "o_orderpriority": "int"})
    return o.select("o_orderkey", (m["o_totalprice"].cast("double") > 0).alias("priced"), m["o_orderpriority"].alias("rank"))


@query("select coalesce(o.o_orderkey, n.k) as doc_id, case when o.o_orderkey is null then 'new' else 'old' end as origin from (select * from orders where o_orderkey % 2 = 0) o full join (select o_orderkey as k from orders where o_orderkey % 3 = 0) n on o.o_orderkey = n.k")
def merge_documents_skip(t):
    o = t("orders").select(F.col("o_orderkey").alias("doc_id"))
    return ingest.merge_documents(o.where("doc_id % 2 = 0").withColumn("origin", F.lit("old")), o.where("doc_id % 3 = 0").withColumn("origin", F.lit("new")), "skip")


@query("select coalesce(o.o_orderkey, n.k) as doc_id, case when n.k is not null then 'new' else 'old' end as origin from (select * from orders where o_orderkey % 2 = 0) o full join (select o_orderkey as k from orders where o_orderkey % 3 = 0) n on o.o_orderkey = n.k")
def merge_documents_replace(t):
    o = t("orders").select(F.col("o_orderkey").alias("doc_id"))
    return ingest.merge_documents(o.where("doc_id % 2 = 0").withColumn("origin", F.lit("old")), o.where("doc_id % 3 = 0").withColumn("origin", F.lit("new")), "replace")


@query("select c_custkey::varchar as pk, case when c_custkey % 5 = 0 then 'add' else 'update' end as action from customer where c_custkey % 17 <> 3 and (c_custkey % 5 = 0 or c_custkey % 7 = 0) union all select c_custkey::varchar, 'delete' from customer where c_custkey % 17 = 3 and c_custkey % 5 <> 0")
def cdc_sync(t):
    return _two_runs(t("customer"))


def _two_runs(c: DataFrame) -> DataFrame:
    """What a second run finds after names changed, rows came and rows went."""
    import uuid

    from graphloom.operators.lineage import folder

    store = changes.Store(c.sparkSession, f"{folder(c.sparkSession)}/sync-{uuid.uuid4().hex[:12]}")
    old = c.where("c_custkey % 5 <> 0").withColumn("c_name", F.when(F.col("c_custkey") % 7 == 0, F.lit("before")).otherwise(F.col("c_name")))
    changes.sync(old, "customer", "c_custkey", store, ["c_nationkey"])
    found = changes.sync(c.where("c_custkey % 17 <> 3"), "customer", "c_custkey", store, ["c_nationkey"])
    return found["delta"].union(found["deleted"].withColumn("action", F.lit("delete")))

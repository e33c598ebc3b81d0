"""The facade's methods on one small graph."""

from pyspark.sql import functions as F

from graphloom.facade import Graph, as_nodes
from graphloom.operators.changes import Store
from graphloom.operators.ingest import Table
from graphloom.operators.ontology import Ontology, Rule, Type


def ids(df, c="id"):
    return sorted(r[0] for r in df.select(c).collect())


def test_tables_and_sync(spark, tmp_path):
    shop = spark.createDataFrame([(1, "Shoe", 5), (2, "Hat", 50), (3, "Sock", 7)], "key long, name string, n long")
    sale = spark.createDataFrame([(10, 1), (11, 2)], "no long, shop long")
    tables = [Table("shop", shop, "key"), Table("sale", sale, "no", {"shop": ("shop", "key")})]
    g = Graph.from_tables(tables, 5.0).checkpoint()
    assert ids(g.filter_nodes("shop", "n", ">", 6)) == ["shop:2", "shop:3"]
    assert ids(g.filter_nodes("shop", "n", ">", 6, from_ids=["shop:Hat"])) == ["shop:2"]
    assert [r.id for r in g.top_nodes("shop", "n", limit=2).collect()] == ["shop:2", "shop:3"]
    assert [(r.group, r.value) for r in g.aggregate_nodes("sale", "shop").collect()] == [("1", 1.0), ("2", 1.0)]
    assert ids(g.join_related(spark.createDataFrame([("shop:1",)], "v string"), "shop", "sale")) == ["sale:10"]
    assert ids(g.neighbours(spark.createDataFrame([("shop:1",)], "id string"))) == ["sale:10"]
    store = Store(spark, str(tmp_path / "state"))
    g2, found = g.sync(tables, store, 6.0)
    assert found["shop"]["delta"].count() == 3 and g2.nodes.count() == 5
    later = [Table("shop", shop.where("key < 3"), "key"), Table("sale", sale.withColumn("shop", F.lit(2).cast("long")), "no", {"shop": ("shop", "key")})]
    g3, found = g2.sync(later, store, 7.0)
    assert ids(g3.nodes) == ["sale:10", "sale:11", "shop:1", "shop:2"]
    assert sorted((r.source_id, r.target_id) for r in g3.edges.collect()) == [("sale:10", "shop:2"), ("sale:11", "shop:2")]
    again = g3.save(str(tmp_path / "graph"))
    assert ids(again.nodes) == ids(g3.nodes) and again.stats().count() == 3


def test_nodes_edges_and_searches(spark):
    rows = [("Data loss", "What a data loss is."), ("Lesson of May", "A failure: data loss in the night, root cause unknown."), ("Backup rule", "Backups must stop data loss.")]
    g = Graph.empty(spark).add(spark.createDataFrame(rows, "title string, content string"), 1.0).checkpoint()
    kinds = {r.title: r.kind for r in g.nodes.collect()}
    assert kinds["Lesson of May"] == "lesson" and kinds["Backup rule"] == "rule" and g.edges.count() == 2
    assert g.search("data loss").count() == 3 and g.search_exact("root cause").count() == 1
    assert g.agent_search("data loss", 2.0, "related_rules").count() == 3
    one = ids(g.search_exact("root cause"))
    assert {r.title for r in g.update(one, 9.0, title=F.lit("June")).get(one).collect()} == {"June"}
    assert g.list("rule").count() == 1 and g.remove(spark.createDataFrame([(one[0],)], "id string")).edges.count() == 1
    assert g.decay().nodes.agg(F.max("vitality")).first()[0] < 1 and g.prune(0.9).edges.count() == 0
    assert len(g.snapshot().splitlines()) > 5 and g.export_json().count() == 5 and g.backfill_needs().count() == 3
    rules = Ontology([Type("rule"), Type("lesson"), Type("concept")], [Rule("related", ["rule"], ["concept"])])
    strict = Graph(g.nodes, g.edges, rules)
    wrong = spark.createDataFrame([(one[0], one[0], "related", 1.0)], "source_id string, target_id string, kind string, weight double")
    assert strict.link(wrong).edges.count() == 2 and strict.invalid_edges(wrong).count() == 1


def test_merge_and_duplicates(spark):
    rows = [("a", "entity", "Berlin City"), ("b", "entity", "Berlin  City"), ("c", "entity", "Oslo")]
    nodes = as_nodes(spark.createDataFrame(rows, "id string, kind string, title string"), 1.0)
    edges = spark.createDataFrame([("c", "b", "related", 1.0), ("a", "b", "related", 1.0)], "source_id string, target_id string, kind string, weight double")
    g = Graph(nodes, edges)
    same = g.resolve()
    assert [(r.old, r.new) for r in same.collect()] == [("b", "a")]
    merged = g.merge(same, 2.0)
    assert ids(merged.nodes) == ["a", "c"] and [(r.source_id, r.target_id) for r in merged.edges.collect()] == [("c", "a")]

"""Views of a small graph, reading documents, Korean particles and backfill."""

from pyspark.sql import functions as F

from graphloom.facade import Graph, as_nodes
from graphloom.functions import text as T
from graphloom.operators import explorer, lifecycle, linking, search, tools

SCHEMA = "id string, kind string, title string, content string, tags array<string>, properties map<string,string>, source string"
ROWS = [
    ("e1", "entity", "Berlin", "", [], {}, "s1"), ("e2", "entity", "Spree", "", [], {}, "s1"), ("c1", "chunk", "c1", "Spree in Berlin", [], {"chunk_index": "1", "parent_doc": "d1"}, ""), ("c2", "chunk", "c2", "old words", [], {"chunk_index": "0"}, ""),
    ("d1", "document", "Doc", "", [], {}, ""), ("com", "community", "Cities", "about cities", [], {}, ""), ("t:1", "entity", "t:one", "", [], {"_table_name": "t", "name": "one", "_primary_key": "id"}, ""), ("u:1", "entity", "u", "", [], {"_table_name": "u", "x": "2"}, ""),
    ("ph", "entity", "phrase", "", ["_phrase"], {}, ""),
]
EDGES = [("c1", "e1", "mentions", 0.8), ("c1", "e2", "mentions", 0.8), ("c2", "c1", "next_chunk", 0.7), ("d1", "c1", "contains", 1.0), ("d1", "c2", "contains", 1.0), ("e1", "com", "part_of", 0.5), ("e2", "com", "part_of", 0.5), ("e1", "e2", "related", 0.4), ("t:1", "u:1", "related", 0.8), ("c2", "ph", "contains", 0.5)]


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def made(spark):
    nodes = as_nodes(spark.createDataFrame(ROWS, SCHEMA), 0.0).drop("source").join(spark.createDataFrame([(r[0], r[6]) for r in ROWS], "id string, source string"), "id")
    return nodes, spark.createDataFrame(EDGES, "source_id string, target_id string, kind string, weight double"), lambda *i: spark.createDataFrame([(x,) for x in i], "id string")


def test_views(spark):
    nodes, edges, ids = made(spark)
    seen = explorer.overview(nodes, edges)
    assert [r.id for r in seen.nodes.orderBy("id").collect()] == ["com", "d1", "e1", "e2", "t:1", "u:1"] and rows(seen.edges, "source_id", "target_id") == [("e1", "com"), ("e1", "e2"), ("e2", "com"), ("t:1", "u:1")]
    assert dict(rows(seen.nodes, "id", "size"))["e1"] == 3
    near = explorer.overview(nodes, edges, root="c2", chunks=True, phrases=True, depth=1)
    assert [r.id for r in near.nodes.collect()][0] in ("c1", "c2", "d1", "ph") and near.nodes.count() == 4
    assert rows(explorer.overview(nodes, edges, source="s1", kinds=["entity"]).nodes, "id") == [("e1",), ("e2",)]
    assert rows(explorer.overview(nodes, edges, source="u").nodes, "id") == [("u:1",)]
    assert rows(explorer.entity_context(nodes, edges, ids("e1", "missing"))) == [("e1", "chunk", "c1", "c1"), ("e1", "community", "com", "Cities"), ("e1", "related", "e2", "Spree")]
    assert rows(explorer.chunk_detail(nodes, edges, ids("c1"))) == [("c1", "entity", "e1", "Berlin", 9, 15), ("c1", "entity", "e2", "Spree", 0, 5), ("c1", "previous", "c2", "c2", None, None)]
    index = linking.chunk_entities(edges)
    assert rows(explorer.edge_evidence(index, edges.where("kind = 'related'"))) == [("e1", "e2", "c1")]
    assert rows(explorer.row_detail(nodes, edges, ids("t:1"))) == [("t:1", "column", "name", "one"), ("t:1", "row", "u", "u:1")]
    assert rows(explorer.community_detail(nodes, edges, ids("com"), 1), "id", "links", "key") == [("e1", 3, True), ("e2", 3, False)]
    assert [tuple(r) for r in explorer.statistics(nodes, edges).collect()] == [(9, 10, 5, 2, 1, 2, 1.5, 4 / 5)]
    assert explorer.statistics(nodes, edges, "s1").first()["nodes"] == 2 and explorer.statistics(nodes.limit(0), edges).first()["edges"] == 0


def test_documents_are_read_by_what_they_share_with_a_query(spark):
    nodes, edges, ids = made(spark)
    assert rows(tools.document(nodes, edges, ids("d1")), "position", "id", "relevant") == [(0, "c2", True), (1, "c1", True)]
    assert rows(tools.document(nodes, edges, ids("c1"), "berlin SPREE", whole=1), "doc", "id", "content", "relevant") == [("d1", "c1", "Spree in Berlin", True), ("d1", "c2", "old words…", False)]
    alone = edges.where("kind <> 'contains'")
    assert rows(tools.document(nodes, alone, ids("c1")), "doc", "id") == [("c1", "c1")] and tools.document(nodes, edges, ids("none")).count() == 0


def test_korean_particles(spark):
    said = "정보화기기를 서울에서 학교의 abc의 나는 Seoul에서"
    assert T.query_without_particles(said) == "정보화기기 서울 학교 abc의 나는 Seoul에서"
    df = spark.createDataFrame([(1, "", said), (2, None, None), (3, "학교", "다른 글")], "id long, title string, content string")
    assert df.select(T.without_particles(F.col("content"))).first()[0] == T.query_without_particles(said)
    assert [r.id for r in search.bm25_korean(df, "학교를", 5).collect()] == [3, 1] and search.bm25(df, "학교를", 5).count() == 0


def test_backfill_fills(spark):
    nodes, edges, ids = made(spark)
    vectors = spark.createDataFrame([("c1", [1.0, 2.0]), ("zz", [1.0, 1.0])], "id string, embedding array<float>")
    n, e = lifecycle.backfill(nodes, edges, vectors=vectors)
    new = rows(n.join(nodes.select("id"), "id", "left_anti"), "kind", "title", "tags")
    assert new and all(k == "entity" and t == ["_phrase"] for k, _, t in new)
    assert n.where("id = 'c1'").first()["embedding"] == [1.0, 2.0] and n.where("id = 'c2'").first()["embedding"] is None
    again, more = lifecycle.backfill(n, e, vectors=vectors)
    assert again.count() == n.count() and more.count() == e.count()
    assert Graph(nodes, edges).backfill().nodes.count() == n.count()

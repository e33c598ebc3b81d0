"""Operators that SQL does not express, and those without a query, on small hand-made inputs."""

import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import changes, documents, evidence, expand, export, graph, ingest, lifecycle, linking, metadata, search, sessions, structured, tools
from graphloom.operators.keyed import Keyed
from graphloom.operators.ontology import Ontology, Property, Rule, Type
from graphloom.sources import readers
from graphloom.streaming.changes import follow

NODE = "id string, kind string, title string, content string, tags array<string>, level int, vitality double, access_count long, success_count long, failure_count long, properties map<string,string>, updated_at double, embedding array<float>"


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def nodes(spark, items):
    """(id, kind, title, content) with counters at rest."""
    return spark.createDataFrame([(i, k, t, c, [], 0, 1.0, 0, 0, 0, {}, float(n), None) for n, (i, k, t, c) in enumerate(items)], NODE)


def edges(spark, items):
    return spark.createDataFrame([(a, b, k, 1.0) for a, b, k in items], "source_id string, target_id string, kind string, weight double")


def test_page_info_and_cursor():
    assert structured.page_info(50, 20) == {"total": 50, "showing": 20, "offset": 0, "has_more": True, "next_cursor": "20"}
    assert structured.page_info(50, 20, "40") == {"total": 50, "showing": 10, "offset": 40, "has_more": False, "next_cursor": None}
    assert [structured.offset_of(c) for c in (None, "x", "-3", "7")] == [0, 0, 0, 7]


def test_long_keys_are_compared_exactly(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big,), (big - 1,), (None,)], "n long")
    assert rows(structured.filter_nodes(df, "n", "=", big)) == [(big,)]
    assert rows(structured.filter_nodes(df, "n", "!=", big)) == [(big - 1,)]


def test_from_ids_by_title_or_id(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 5), (3, "c", 5)], "id long, title string, n long")
    assert rows(structured.filter_nodes(df, "n", ">", 1, ["2", "c", "zz"], ["id", "title"]), "id") == [(2,), (3,)]


def test_chunks_overlap(spark):
    text = ". ".join(f"s{i} " + "x" * 90 for i in range(30)) + "."
    parts = documents.split_chunks(text)
    assert all(sum(len(s) for s in documents.BREAK.split(p)) <= 1000 for p in parts) and len(parts) > 2
    for a, b in zip(parts, parts[1:], strict=False):
        tail = documents.BREAK.split(b)[:2]
        assert a.endswith(" ".join(tail))  # two sentences of some 95 characters fit into 200
    assert documents.split_chunks("") == [""] and documents.split_chunks("y" * 3000) == ["y" * 3000]
    df = spark.createDataFrame([(1, None), (2, "a. b")], "doc_id long, text string")
    assert rows(documents.chunks(df)) == [(1, 0, ""), (2, 0, "a. b")]


def test_korean_phrases_and_connectives(spark):
    df = spark.createDataFrame([("사업계획을 수립하고 예산에서 지원",)], "t string")
    got = df.select(T.korean_phrases(F.col("t"))).first()[0]
    assert {"사업계획", "예산", "지원"} <= set(got) and "사업계획 수립하고" in got and "예산에서" not in got
    chunks = spark.createDataFrame([("c1", "", "안전관리규정에 따라 점검한다"), ("c2", "t", "nothing")], "id string, title string, content string")
    assert rows(linking.connective_links(chunks, {"안전관리규정": "r1", "규정": "r2"})) == [("c1", "r1", "depends_on", 0.7)]


def test_nfc_and_records(spark):
    df = spark.createDataFrame([("Policy", "Café must comply"), (None, None)], "title string, content string")
    made = {r.title: r for r in ingest.add_records(df).collect()}
    assert made["Policy"].content == "Café must comply" and made["Policy"].kind == "rule" and made[""].kind == "concept"
    assert rows(ingest.add_records(df), "id") == rows(ingest.add_records(df), "id")


def test_query_rules():
    assert T.decompose("매출과 직원수") == ["매출", "직원수"]
    assert T.decompose("cats and dogs compare") == ["cats", "dogs"]
    assert T.decompose("매출 2020년부터 2024년까지") == ["매출 2020년", "매출 2024년"]
    assert T.decompose("one topic") == ["one topic"] and T.decompose(" ") == []
    assert T.compared("인권경영과 예산 편성의 관계") == ["인권경영", "예산 편성"]
    assert "deploy error" in T.expand_synonyms("deploy bug") and "release bug" in T.expand_synonyms("deploy bug")
    assert T.asks_for_all("list all rules") and T.asks_for_all("모든 규정") and not T.asks_for_all("one rule")
    assert T.suggest_intent("why did it fail with an error") == "past_failures" and T.suggest_intent("zzz") == "general"
    assert tools.level_of("overall trend") == "high" and tools.level_of("about Berlin") == "low"


def test_ontology():
    o = Ontology([Type("a", "", [Property("x", "int", True)]), Type("b", "a", [Property("x", "str")]), Type("c", "b"), Type("l1", "l2"), Type("l2", "l1")], [Rule("e", ["a"], [])])
    assert o.ancestors("c") == ["b", "a"] and o.is_a("c", "a") and not o.is_a("a", "c") and o.subtypes("a") == ["b", "c"]
    assert o.properties("c")["x"].kind == "str" and not o.properties("c")["x"].required
    assert o.ancestors("l1") == ["l2", "l1"][:2]
    again = Ontology.from_json(o.to_json())
    assert again.to_json() == o.to_json()
    assert Ontology.from_toml('[[types]]\nname = "a"\n[[types]]\nname = "b"\nparent = "a"\n').is_a("b", "a")


def test_metadata(spark):
    df = spark.createDataFrame([({"valid_from": "2000", "valid_to": "2010", "authority": "7", "version": "v2"},), ({"authority": "x"},), ({},)], "p map<string,string>")
    got = [tuple(r) for r in df.select(metadata.is_current(F.col("p"), 2005), metadata.is_current(F.col("p"), 2011), metadata.authority(F.col("p"), 5), metadata.version(F.col("p")), metadata.year(F.col("p"))).collect()]
    assert got == [(True, False, 7, "v2", None), (True, True, 5, "", None), (True, True, 5, "", None)]


def test_table_ingest(spark):
    shop = spark.createDataFrame([(1, "Shoe", "red"), (2, "", "blue")], "id long, name string, colour string")
    sale = spark.createDataFrame([(10, 1, 5), (11, 9, 6), (12, None, 7)], "id long, shop_id long, n long")
    both = spark.createDataFrame([(1, 10), (1, 10), (2, 11)], "shop_id long, sale_id long")
    tables = [ingest.Table("shop", shop, "id"), ingest.Table("sale", sale, "id", {"shop_id": ("shop", "id")}), ingest.Table("both", both, None, {"shop_id": ("shop", "id"), "sale_id": ("sale", "id")})]
    n, e = ingest.ingest_tables(tables)
    assert rows(n, "id", "title")[-2:] == [("shop:1", "shop:Shoe"), ("shop:2", "shop:2")] and n.count() == 5
    assert rows(e, "source_id", "target_id") == [("sale:10", "shop:1"), ("shop:1", "sale:10"), ("shop:2", "sale:11")]
    _, kept = ingest.ingest_tables(tables, keep_dangling=True)
    assert ("sale:11", "shop:9") in rows(kept, "source_id", "target_id")
    assert graph.property_samples(n).where("property = 'colour'").first().samples == "blue, red"
    assert ingest.column_priority("goods_nm") == 0 and ingest.column_priority("zz") == 4
    nodes_, edges_ = readers.from_database(tables)
    assert nodes_.count() == 5 and edges_.count() == 3


def test_sync_by_watermark_and_drift(spark, tmp_path):
    make = lambda r: spark.createDataFrame(r, "id long, name string, cat long, updated_at long")
    store = changes.Store(spark, str(tmp_path))
    first = make([(1, "a", 1, 999), (2, "b", 1, 1000), (3, "c", 2, 998)])
    run = changes.sync(first, "t", "id", store, ["cat"])
    assert rows(run["delta"]) == [("1", "add"), ("2", "add"), ("3", "add")] and run["deleted"].count() == 0
    assert run["state"].watermark == "1000" and run["state"].version == 1
    assert rows(changes.sync(first, "t", "id", store, ["cat"])["delta"]) == []
    second = make([(1, "a", 1, 999), (2, "B", 3, 1200), (4, "d", 1, 1001)])
    run = changes.sync(second, "t", "id", store, ["cat"])
    assert rows(run["delta"]) == [("2", "update"), ("4", "add")] and rows(run["deleted"]) == [("3",)]
    assert rows(run["moved"]) == [("2", "cat", "1", "3")]
    wider = second.withColumn("extra", F.lit(1))
    run = changes.sync(wider, "t", "id", store, ["cat"])
    assert run["schema_changed"] and run["delta"].count() == 3 and run["deleted"].count() == 0
    less = wider.where("id <> 2").withColumn("more", F.lit("x"))
    run = changes.sync(less, "d", "id", store, ["cat"])
    run = changes.sync(wider, "d", "id", store, ["cat"])
    assert run["schema_changed"] and run["deleted"].count() == 0
    run = changes.sync(less, "d", "id", store, ["cat"])
    assert run["schema_changed"] and rows(run["deleted"]) == [("2",)] and rows(store.index(run["state"]), "pk") == [("1",), ("4",)]
    found = changes.sync_all([ingest.Table("t", wider, "id"), ingest.Table("u", wider, None)], store)
    assert found["u"] == {"error": "no key"} and found["t"]["delta"].count() == 0
    assert changes.change_column(spark.createDataFrame([], "created_at long, Last_Update long")) == "Last_Update"
    assert changes.change_column(spark.createDataFrame([], "created_at long, ts long")) is None


def test_sync_by_watermark_reads_little(spark, tmp_path):
    """Past the watermark alone rows are hashed, the condition reaches the files, and the index grows by what changed."""
    store = changes.Store(spark, str(tmp_path / "store"), buckets=8)
    at = lambda name, df: (df.write.mode("overwrite").parquet(str(tmp_path / name)), spark.read.parquet(str(tmp_path / name)))[1]
    first = at("one", spark.range(400).selectExpr("id", "concat('n', id) as name", "id % 7 as cat", "id as updated_at"))
    changes.sync(first, "t", "id", store, ["cat"])
    past = changes.changed_since(first, "updated_at", "399")
    plan = past._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(updated_at,399)" in plan
    second = at("two", first.where("id <> 5").selectExpr("id", "if(id = 17, 'new', name) as name", "if(id = 17, 0, cat) as cat", "if(id = 17, 500, updated_at) as updated_at"))
    run = changes.sync(second, "t", "id", store, ["cat"])
    assert rows(run["delta"]) == [("17", "update")] and rows(run["deleted"]) == [("5",)] and rows(run["moved"]) == [("17", "cat", "3", "0")]
    commits = store._table("t").commits()
    assert [c.base for c in commits] == [True, False] and len(commits[1].buckets) <= 2
    assert run["state"].watermark == "500" and run["state"].rows == 399
    whole = changes.Store(spark, str(tmp_path / "whole"))
    changes.sync(second, "t", "id", whole, ["cat"])
    assert rows(store.index(store.load("t")).select("pk", "row_hash")) == rows(whole.index(whole.load("t")).select("pk", "row_hash"))
    for i in range(4):  # many small runs are compacted, and nothing changes by that
        third = at(f"r{i}", second.selectExpr("id", f"if(id = 3, 'r{i}', name) as name", "cat", f"if(id = 3, 600 + {i}, updated_at) as updated_at"))
        run = changes.sync(third, "t", "id", store, ["cat"])
        assert rows(run["delta"]) == [("3", "update")]
    assert store._table("t").compact(2) and changes.sync(third, "t", "id", store, ["cat"])["delta"].count() == 0


def test_streaming_merge(spark, tmp_path):
    inbox = str(tmp_path / "in")
    schema = "id long, v string, at long, gone boolean"
    target = Keyed(spark, str(tmp_path / "out"), ["id"], "id long, v string, at long", buckets=4)
    target.write(spark.createDataFrame([(1, "old"), (7, "kept")], "id long, v string").withColumn("at", F.lit(0).cast("long")), base=True)
    spark.createDataFrame([(1, "x", 2, False), (1, "y", 1, False), (2, "z", 1, False)], schema).write.parquet(f"{inbox}/a")
    read = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(inbox)
    follow(read(), target, str(tmp_path / "ck"), "at", "gone").awaitTermination()
    assert rows(target.read(), "id", "v") == [(1, "x"), (2, "z"), (7, "kept")]
    spark.createDataFrame([(2, "zz", 5, True), (3, "n", 5, False)], schema).write.mode("append").parquet(f"{inbox}/b")
    follow(read(), target, str(tmp_path / "ck"), "at", "gone", most=1).awaitTermination()
    assert rows(target.read(), "id", "v") == [(1, "x"), (3, "n"), (7, "kept")]
    assert target.meta() == {"batch": 1} and len(target.commits()[1].buckets) < 4


def test_readers(spark, tmp_path):
    (tmp_path / "p.csv").write_text("code,name\nA,Shoe\nB,Hat\n")
    n, _ = readers.from_data(spark, str(tmp_path / "p.csv"))
    assert rows(n, "id", "title") == [("p:A", "p:Shoe"), ("p:B", "p:Hat")]
    (tmp_path / "d.jsonl").write_text('{"doc_id": "1", "title": "T", "content": "Hello."}\nnot json\n{"title": "no id"}\n')
    n, e = readers.from_data(spark, str(tmp_path / "d.jsonl"))
    assert rows(n, "title", "content") == [("T", "Hello.")] and e.count() == 0
    (tmp_path / "a.txt").write_text("Some text")
    assert rows(readers.from_data(spark, str(tmp_path / "a.txt"))[0], "title") == [("a.txt",)]
    n, e = readers.from_chunks(spark.createDataFrame([("d", 0, "x"), ("d", 1, "y"), ("d", 2, "z")], "doc_id string, index int, text string"))
    assert n.count() == 4 and e.groupBy("kind").count().where("kind = 'contains'").first()[1] == 3 and e.where("kind = 'next_chunk'").count() == 2
    assert readers.dialect("jdbc:mariadb://h/db") == "mysql"
    with pytest.raises(ValueError):
        readers.dialect("jdbc:unknown://h")
    made = readers.tables_of([("t", "id", "int", True), ("t", "r", "int", 0), ("u", "a", "int", 1), ("u", "b", "int", 1)], [("t", "r", "u", "a")], lambda name: name)
    assert [(t.name, t.key, t.foreign) for t in made] == [("t", "id", {"r": ("u", "a")}), ("u", None, {})]


def test_duplicates_against_all_pairs(spark):
    rng = random.Random(3)
    titles = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(4, 30))) for _ in range(60)]
    for t in titles[:25]:
        at = rng.randrange(len(t))
        titles.append(t[:at] + rng.choice("xyz") + t[at + rng.randint(0, 1) :])
    items = [(f"n{i:03d}", "ab"[i % 7 == 0], t) for i, t in enumerate([*titles, titles[0], titles[0]])]
    first = {}
    for a, k, x in items:
        first.setdefault((k, x.lower()), a)
    want = {(first[k, x.lower()], a) for a, k, x in items if first[k, x.lower()] != a}
    for (k, x), a in first.items():
        for (m, y), b in first.items():
            if k == m and x < y and difflib.SequenceMatcher(None, x, y).ratio() >= 0.85:
                want.add((min(a, b), max(a, b)))
    df = spark.createDataFrame(items, "id string, kind string, title string")
    got = {(r.a, r.b) for r in linking.duplicates(df, 0.85, limit=None).collect()}
    assert got == want and len(want) > 15


def test_resolution_and_merge(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "a string, b string")
    n = spark.createDataFrame([(i, "entity", i.upper(), f"text {i}", [i], 0, v, c, 1, 0, {}, 0.0, None) for i, c, v in [("a", 1, 0.1), ("b", 5, 0.2), ("c", 5, 0.9), ("x", 0, 0.0), ("y", 0, 0.0), ("z", 0, 0.5)]], NODE)
    same = linking.resolutions(pairs, n)
    assert rows(same, "old", "new") == [("a", "b"), ("c", "b"), ("y", "x")]
    merged = {r.id: r for r in graph.merge_contents(n, same).collect()}
    assert set(merged) == {"b", "x", "z"} and merged["b"].content == "text b\n\ntext a\n\ntext c" and merged["b"].tags == ["b", "a", "c"]
    assert (merged["b"].access_count, merged["b"].success_count, merged["b"].vitality) == (11, 3, 0.9)


def test_reference_links_by_scope(spark):
    items = [("a1", "see art. 2 and art. 1", "X", "art. 1"), ("a2", "none", "X", "art. 2"), ("b2", "of Law X art. 1 and art. 2", "Y", "art. 2"), ("b9", "art. 3", "Y", None)]
    n = spark.createDataFrame(items, "id string, content string, law string, key string")
    got = rows(linking.reference_links(n, "key", "art[.] [0-9]+", "law", "Law (\\w+) (art[.] [0-9]+)"), "source_id", "target_id")
    assert got == [("a1", "a2"), ("b2", "a1")]
    noisy = n.withColumn("key", F.lit("art. 1"))
    assert linking.reference_links(noisy, "key", "art[.] [0-9]+").count() == 0


def test_relations(spark):
    n = spark.createDataFrame([("1", "lesson", "Outage", "We saw Data Loss today", ["x", "y", "z"]), ("2", "concept", "Data loss", "", ["x", "y"]), ("3", "rule", "R", "data loss is forbidden", ["q"]), ("4", "concept", "Data", "", ["x", "q"])], "id string, kind string, title string, content string, tags array<string>")
    got = rows(linking.relations(n))
    assert got == [("1", "2", "learned_from", 0.8), ("1", "4", "learned_from", 0.8), ("2", "1", "related", 0.5), ("3", "2", "depends_on", 0.8), ("3", "4", "depends_on", 0.8)]


def test_expand_paths(spark):
    n = nodes(spark, [("cat", "concept", "C", ""), ("d1", "entity", "D1", ""), ("d2", "entity", "D2", ""), ("c1", "chunk", "", "x"), ("c2", "chunk", "", "y"), ("law", "entity", "L", ""), ("far", "entity", "F", "")])
    e = edges(spark, [("d1", "cat", "part_of"), ("d2", "cat", "part_of"), ("d1", "c1", "contains"), ("c1", "c2", "next_chunk"), ("c1", "law", "references"), ("d1", "far", "related"), ("far", "law", "related")])
    seeds = spark.createDataFrame([("c1", 0), ("d1", 1)], "id string, rank int")
    cats = spark.createDataFrame([("cat",)], "id string")
    got = {r.id: (r.reason, r.anchor) for r in expand.expand(n, e, seeds, cats).collect()}
    assert got == {"c1": ("seed", None), "d1": ("seed", None), "law": ("references", "c1"), "d2": ("category_sibling", "cat"), "c2": ("chunk_next", "c1"), "cat": ("document_chunk", "d1"), "far": ("related", "d1")}
    assert expand.expand(n, e, seeds, cats, expand.Budget(total=3)).count() == 3
    assert expand.table_anchors("best selling shoes", {"sales": ["selling"], "staff": ["employee"]}) == ["sales"]


def test_topological_and_chain(spark):
    assert expand.topological(["c", "b", "a", "x", "y"], [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")]) == ["a", "b", "c", "x", "y"]
    n = nodes(spark, [("a", "decision", "A", "We chose it. It cost 20 million."), ("m", "outcome", "M", "Then it broke."), ("b", "lesson", "B", "Never again.")])
    e = edges(spark, [("a", "m", "resulted_in"), ("m", "b", "caused")])
    got = rows(expand.evidence_chain(n, e, ["b", "a"], "cost of it"), "step", "id", "role", "facts")
    assert got == [(0, "a", "seed", ["It cost 20 million."]), (1, "m", "bridge", []), (2, "b", "seed", [])]


def test_sessions(spark):
    log = spark.createDataFrame([("s", 1.0, "decision", "D", "why", "ctx"), ("s", 2.0, "outcome", "O", "done", "dec"), ("r", 1.0, "tool_call", "T", None, None)], "session string, at double, kind string, title string, content string, refers string")
    n, e = sessions.activities(log)
    assert n.count() == 3 and rows(e.groupBy("kind").count()) == [("depends_on", 1), ("followed_by", 1), ("part_of", 3), ("resulted_in", 1)]
    assert [r.title for r in sessions.timeline(n, e, "s").collect()] == ["D", "O"]
    chain = edges(spark, [("d", "o", "resulted_in"), ("l", "o", "learned_from"), ("k", "d", "learned_from")])
    assert rows(sessions.decision_chain(chain, "d")) == [("k", "lesson"), ("l", "lesson"), ("o", "outcome")]
    assert sessions.expired(sessions.session_info(log).withColumnRenamed("session", "id"), 5000.0).count() == 2


def test_exports(spark):
    n = nodes(spark, [("a", "rule", "R", "text"), ("b", "concept", "C", "y" * 30)]).withColumn("source", F.lit("src"))
    e = edges(spark, [("a", "b", "related"), ("a", "gone", "related")])
    lines = "\n".join(r.line for r in export.markdown_lines(n).collect())
    assert lines.index("## Concept") < lines.index("## Rule") and "- **Source**: src" in lines and "- **Vitality**: 1.00" in lines
    got = [(r.part, json.loads(r.line)) for r in export.json_rows(n, e).collect()]
    assert sum(p == "edge" for p, _ in got) == 1 and {x["id"] for p, x in got if p == "node"} == {"a", "b"}
    short, blobs = export.offload(n, 20)
    assert rows(short, "id", "content") == [("a", "text"), ("b", "blob://b")]
    assert rows(export.restore(short, blobs), "id", "content") == rows(n, "id", "content")
    assert "node rule 1" in export.report(n, e)


def test_intents_and_reading(spark):
    n = nodes(spark, [("d", "decision", "D", "x"), ("o", "outcome", "O", "x"), ("l", "lesson", "L", "x"), ("c", "chunk", "C", "body")])
    n = n.withColumn("failure_count", F.when(F.col("id") == "o", 2).otherwise(0)).withColumn("properties", F.create_map(F.lit("chunk_index"), F.lit("0")))
    e = edges(spark, [("d", "o", "resulted_in"), ("l", "o", "learned_from"), ("l", "c", "contains")])
    hits = spark.createDataFrame([("o", 1.0)], "id string, score double")
    assert rows(tools.by_intent(hits, n, e, "past_failures", 10.0), "id", "relevance") == [("d", 0.8), ("l", 0.6), ("o", 1.0)]
    hits = spark.createDataFrame([("d", 1.0)], "id string, score double")
    got = tools.by_intent(hits, n, e, "reasoning_chain", 10.0).collect()
    assert [(r.id, round(r.relevance, 6)) for r in got] == [("d", 1.0), ("o", 0.8), ("l", 0.6)]
    assert {r.id for r in tools.by_intent(hits, n, e, "context_explore", 10.0).collect()} >= {"d", "o"}
    assert rows(tools.around(n, e, "o"), "id", "edge", "way") == [("d", "resulted_in", "in"), ("l", "learned_from", "in")]
    assert rows(tools.read_document(n, e, "l"), "position", "content") == [(0, "body")]


def test_legacy_search(spark):
    items = [(f"n{i}", "lesson" if i % 2 else "concept", f"title {i}", f"the failure of pump {i}" if i < 6 else f"quiet {i}") for i in range(12)]
    n = nodes(spark, items).withColumn("tags", F.when(F.col("id") == "n4", F.array(F.lit("pump"))).otherwise(F.array().cast("array<string>")))
    got = tools.legacy(n, "pump failure", 100.0, limit=10).collect()
    assert {r.id for r in got} == {f"n{i}" for i in range(6)} and got == sorted(got, key=lambda r: (-r.resonance, r.id))
    assert tools.legacy(n, "absent", 100.0).count() == 0
    page = tools.search_page(n, "pump", kind="lesson").collect()
    assert {r.id for r in page} == {"n1", "n3", "n5"} and "pump" in page[0].snippet
    mean, share = tools.calibrate(n.where("id < 'n2'"))
    assert 0 <= mean <= 1 and share in (0.0, 0.1, 0.2)
    again = tools.table_hint_seeds(n.withColumn("properties", F.create_map(F.lit("_table_name"), F.lit("pumps"))), "pump", spark.createDataFrame([], "id string"), {"pumps": ["pump"]})
    assert again.count() == 5


def test_evidence_choice_with_categories(spark):
    items = [(0, "a", "d1", 0.9, ["x", "y"], "k1", "", ""), (0, "b", "d1", 0.8, ["x", "z"], "k1", "", ""), (0, "c", "d1", 0.7, ["q"], "k1", "", ""), (0, "e", "d2", 0.1, ["w"], "k2", "", ""), (0, "f", "d3", 0.3, ["x", "y"], "", "references", "a")]
    df = spark.createDataFrame(items, "query_id int, id string, doc_id string, total double, words array<string>, category string, reason string, anchor string")
    got = [r.id for r in evidence.choose(df, 4, categories=["k2"]).orderBy("rank").collect()]
    assert got == ["e", "a", "f", "c"]  # b: 0.56 - 0.1, c: 0.49


def test_pagerank_stops_when_still(spark):
    e = edges(spark, [("a", "b", "related"), ("b", "c", "related")])
    seeds = spark.createDataFrame([("a", 2.0)], "id string, weight double")
    far = {r.id: r.score for r in graph.personalized_rank(e, seeds, rounds=60, tol=0.0, every=30).collect()}
    near = {r.id: r.score for r in graph.personalized_rank(e, seeds).collect()}
    assert set(far) == set(near) and all(abs(far[i] - near[i]) < 1e-3 for i in far) and near["a"] > near["c"]
    alone = spark.createDataFrame([("z", 3.0)], "id string, weight double")
    assert rows(graph.personalized_rank(e, alone)) == [("z", 3.0)]


def test_upkeep(spark):
    n = nodes(spark, [("a", "rule", "", "x"), ("b", "rule", "", "x")])
    e = edges(spark, [("a", "b", "related")]).withColumn("weight", F.lit(0.05))
    kept, left, judged = lifecycle.maintain(n, e, 1e9)
    assert kept.count() == 0 and left.count() == 0 and rows(judged, "id", "action") == [("a", "delete"), ("b", "delete")]
    strong = spark.createDataFrame([("a", "b", "related", 9.0), ("a", "c", "related", 1.0)], "source_id string, target_id string, kind string, weight double")
    pairs = spark.createDataFrame([("a", "c", 0)], "source_id string, target_id string, maturity int")
    assert rows(lifecycle.reinforce(strong, pairs), "target_id", "weight") == [("b", 9.0), ("c", 1.1)]
    assert rows(graph.upsert_edges(strong, strong.withColumn("weight", F.lit(2.0))), "target_id", "weight") == [("b", 2.0), ("c", 2.0)]
    n2, e2 = graph.delete_nodes(n, strong, spark.createDataFrame([("b",)], "id string"))
    assert rows(n2, "id") == [("a",)] and rows(e2, "target_id") == [("c",)]


def test_metrics_f1(spark):
    run = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, id string, rank int")
    rel = spark.createDataFrame([(1, "b"), (1, "c")], "query_id int, id string")
    m = search.metrics(run, rel, 2).first()
    assert (m.precision, m.recall, m.rr) == (0.5, 0.5, 0.5) and m.f1 == 0.5

"""Database files and mixed folders, read as one graph."""

import json
import sqlite3

import pytest

from graphloom.facade import Graph
from graphloom.operators import changes
from graphloom.sources import folder, readers, sqlite


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


@pytest.fixture
def shop(tmp_path):
    """Tables with keys and foreign keys, a bridge, odd values, no row numbers, and no rows."""
    path = str(tmp_path / "shop.db")
    con = sqlite3.connect(path)
    con.executescript("""
        create table maker (id integer primary key, name text not null, founded int);
        create table item (id integer primary key, name text, price real, sold bool, maker_id int references maker(id), code int, updated_at int);
        create table tag (id integer primary key, label text);
        create table item_tag (item_id int references item, tag_id int references tag, primary key (item_id, tag_id)) without rowid;
        create table "odd ""name" (k text primary key, v blob);
        create table emptied (id integer primary key, x text);
    """)
    con.executemany("insert into maker values (?, ?, ?)", [(1, "Acme", 1900), (2, "Bolt", None)])
    con.executemany("insert into item values (?, ?, ?, ?, ?, ?, ?)", [(i, f"thing {i}", i / 2, i % 2, 1 + i % 3, "x9" if i == 7 else i, 1000 + i) for i in range(1, 41)])
    con.executemany("insert into tag values (?, ?)", [(1, "red"), (2, "blue")])
    con.executemany("insert into item_tag values (?, ?)", [(1, 1), (1, 2), (2, 1)])
    con.execute("""insert into "odd ""name" values ('a', x'ff41')""")
    con.commit()
    return path, con


def test_sqlite_types_ranges_and_filters(spark, shop):
    path, _ = shop
    item = sqlite.table(spark, f"sqlite://{path}", "item", parts=5)
    assert dict(item.dtypes) == {"id": "bigint", "name": "string", "price": "double", "sold": "boolean", "maker_id": "bigint", "code": "string", "updated_at": "bigint"}
    assert item.rdd.getNumPartitions() == 5 and item.count() == 40
    assert rows(item.where("id in (1, 7)"), "id", "price", "sold", "code") == [(1, 0.5, True, "1"), (7, 3.5, True, "x9")]
    assert rows(item.where("updated_at >= 1039 and name <> 'thing 40'"), "id") == [(39,)]
    assert rows(item.where("code = '7' or id = 2"), "id") == [(2,)]
    assert rows(sqlite.table(spark, path, "item", ["name", "id"]).where("id = 3")) == [("thing 3", 3)]
    assert sqlite.table(spark, path, "emptied").count() == 0 and rows(sqlite.table(spark, path, "item_tag")) == [(1, 1), (1, 2), (2, 1)]
    assert rows(sqlite.table(spark, path, 'odd "name')) == [("a", "�A")]
    with pytest.raises(Exception, match="no table"):
        sqlite.table(spark, path, "missing").count()


def test_sqlite_conditions_reach_the_file(spark, shop):
    path, con = shop
    reader = sqlite.Reader(path, "item", sqlite.table_schema(con, "item"), 3, [("updated_at", ">=", 1030), ("maker_id", "<", 3)])
    assert reader.tests == ['"updated_at" >= ?', '"maker_id" < ?']
    got = [r for p in reader.partitions() for r in reader.read(p)]
    assert sorted(r[0] for r in got) == [i for i in range(30, 41) if 1 + i % 3 < 3]
    some = sqlite.table(spark, path, "item", ["id"], [("updated_at", ">", 1038)])
    assert some.columns == ["id"] and rows(some) == [(39,), (40,)] and rows(some.where("id = 40")) == [(40,)] and rows(some) == [(39,), (40,)]
    with pytest.raises(ValueError):
        sqlite.table(spark, path, "item", where=[("id", "; drop table", 1)])


def test_database_as_graph_in_full_and_by_changes(spark, shop, tmp_path):
    path, con = shop
    found = readers.database_tables(spark, f"sqlite:{path}")
    assert [(t.name, t.key, t.bridge, t.foreign) for t in found if t.name in ("item", "item_tag")] == [("item", "id", False, {"maker_id": ("maker", "id")}), ("item_tag", None, True, {"tag_id": ("tag", "id"), "item_id": ("item", "id")})]
    g = Graph.from_database(spark, f"sqlite:{path}", 0.0)
    assert g.nodes.count() == 2 + 40 + 2 + 1 and rows(g.nodes.where("id = 'maker:1'"), "title") == [("maker:Acme",)]
    edges = rows(g.edges, "source_id", "target_id")
    assert ("item:1", "maker:2") in edges and ("item:2", "maker:3") not in edges and len([e for e in edges if e[0].startswith(("tag", "item:1")) and e[1].startswith(("tag", "item"))]) >= 2
    store = changes.Store(spark, str(tmp_path / "store"))
    tables = [t for t in found if t.name in ("item", "maker", "item_tag")]
    first = readers.from_database(tables, "auto", store) if store.load("item").version else readers.from_database(tables, "cdc", store)
    assert first["item"]["delta"].count() == 40 and "item_tag" not in first
    con.executescript("update item set name = 'new', maker_id = 1, updated_at = 5000 where id = 4; delete from item where id = 9; insert into item values (99, 'n', 1.0, 0, 1, 1, 5001)")
    con.commit()
    again = readers.from_database([t for t in readers.database_tables(spark, f"sqlite:{path}") if t.name in ("item", "maker")], "auto", store)
    assert rows(again["item"]["delta"]) == [("4", "update"), ("99", "add")] and rows(again["item"]["deleted"]) == [("9",)]
    assert rows(again["item"]["moved"]) == [("4", "maker_id", "2", "1")] and again["maker"]["delta"].count() == 0


def test_mixed_folder(spark, tmp_path):
    base = tmp_path / "data"
    (base / "law").mkdir(parents=True)
    (base / "notes").mkdir()
    (base / "items.csv").write_text("code,name\nA,Shoe\nB,Hat\n")
    (base / "law" / "items.csv").write_text("code,name\nC,Coat\n")
    (base / "docs.jsonl").write_text('{"doc_id": "1", "title": "One", "content": "First text.", "category": "c1"}\nnot json\n{"title": "no id"}\n\n{"doc_id": "2", "chunks": [{"text": "later", "index": 1}, {"text": "sooner", "index": 0}]}\n')
    (base / "law" / "act.txt").write_text("Some act")
    (base / "notes" / "a.md").write_text("intro\n\n## The *head* ##\nbody")
    (base / "notes" / "page.html").write_text("<html><head><title>A &amp; B</title><style>x{}</style></head><body><p>One<p>Two&nbsp;three<script>no()</script></body></html>")
    (base / "notes" / "broken.rec").write_text("boom")
    (base / "notes" / "two.rec").write_text("p|q")
    (base / "notes" / ".hidden.txt").write_text("hidden")
    (base / "picture.png").write_bytes(b"\x89PNG")

    def records(data, path):
        if data == b"boom":
            raise ValueError("cannot be read")
        return [(None, part) for part in data.decode().split("|")]

    folder.register_parser(".rec", records)
    try:
        got = folder.read(spark, str(base))
        nodes = rows(got.nodes, "title", "content", "kind")
    finally:
        del folder.PARSERS["rec"]
    want = {("items:Shoe", "items: Shoe | A", "entity"), ("items:Coat", "items: Coat | C", "entity"), ("One", "First text.", "concept"), ("2", "sooner\nlater", "concept"), ("act.txt", "Some act", "concept"), ("A & B", "One\nTwo three", "concept"), ("two.rec", "p", "concept"), ("two.rec", "q", "concept"), ("law", "", "concept"), ("c1", "", "concept"), ("notes", "", "concept")}
    assert want <= set(nodes) and not [n for n in nodes if "hidden" in n[1] or "boom" in n[1]]
    assert [n for n in nodes if n[0] == "The *head*"]
    report = {r.kind: (r.files, r.records, r.bad) for r in got.report.collect()}
    assert report == {"csv": (2, 3, 0), "jsonl": (1, 2, 2), "txt": (1, 1, 0), "md": (1, 1, 0), "html": (1, 1, 0), "rec": (2, 2, 1), "png": (1, 0, 0)}
    assert got.edges.where("kind = 'part_of'").count() == 1 + 1 + 2 + 2
    n, _ = readers.from_data(spark, str(base))
    assert n.count() == len(nodes) - 2
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "x.bin").write_text("?")
    with pytest.raises(ValueError):
        folder.read(spark, str(empty))
    json.dumps(report)


def test_chunks_made_elsewhere(spark):
    schema = "doc_id string, chunk_index int, content string, title string, category string, source string, page int"
    made = [("d", 1, "second", None, None, None, 2), ("d", 0, "First line\nmore", None, "manual", "a.pdf", 1), (None, None, "alone", "Own title", "", None, None), ("d", 2, "  ", None, None, None, None), ("e", None, "b text", None, "manual", None, None), ("e", None, "a text", None, None, None, None)]
    nodes, edges = readers.from_chunks(spark.createDataFrame(made, schema))
    assert rows(nodes.where("kind = 'document'"), "title") == [("First line",), ("Own title",), ("a text",)]
    assert rows(nodes.where("kind = 'chunk'"), "content", "title") == [("First line\nmore", "First line"), ("a text", "a text"), ("alone", "Own title"), ("b text", "b text"), ("second", "second")]
    assert rows(nodes.where("kind = 'concept'"), "title") == [("manual",)]
    counts = {r.kind: r["count"] for r in edges.groupBy("kind").count().collect()}
    assert counts == {"contains": 5, "next_chunk": 2, "part_of": 1}
    one = nodes.where("content = 'second'").first().properties
    assert one == {"doc_id": "d", "chunk_index": "1", "page": "2"}
    g = Graph.from_chunks(spark.createDataFrame(made, schema), 0.0)
    assert g.nodes.count() == 9
    assert readers.from_chunks(spark.createDataFrame([], schema))[0].count() == 0

"""Plugins by name, profiles as TOML, and sessions as a stream."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from graphloom import plugins
from graphloom.operators import ingest, linking, profiles
from graphloom.streaming import sessions


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_plugins_of_ones_own(spark):
    @F.udtf(returnType="phrase string")
    class Codes:
        def eval(self, text: str):
            for word in text.split():
                if word.isupper():
                    yield (word.lower(),)

    plugins.register("tagger", "urgent", lambda text: F.when(F.contains(F.lower(text), F.lit("asap")), F.array(F.lit("urgent"))))
    plugins.register("classifier", "memo", lambda title, content: F.struct(F.lit("memo").alias("kind"), F.lit(1.0).alias("confidence")))
    plugins.register("extractor", "codes", Codes)
    plugins.register("extractor", "long", lambda text: F.filter(F.split(text, " "), lambda w: F.length(w) > 6))
    plugins.register("detector", "same_kind", lambda n: n.alias("x").join(n.alias("y"), (F.col("x.kind") == F.col("y.kind")) & (F.col("x.id") != F.col("y.id"))).select(F.col("x.id").alias("source_id"), F.col("y.id").alias("target_id"), F.lit("same").alias("kind"), F.lit(0.1).alias("weight")))
    try:
        made = ingest.add_records(spark.createDataFrame([("Fix", "please ASAP test"), ("Other", None)], "title string, content string"), "memo", ("rules", "urgent"))
        assert rows(made, "title", "kind", "tags") == [("Fix", "memo", ["test", "bug", "urgent"]), ("Other", "memo", [])]
        told = spark.createDataFrame([("A", "b", "decision"), ("C", "must follow the rule", "")], "title string, content string, kind string")
        assert rows(ingest.add_records(told), "title", "kind") == [("A", "decision"), ("C", "rule")]
        docs = spark.createDataFrame([(1, "see ABC and xylophone ABC"), (2, None), (3, "nothing")], "doc_id long, text string")
        assert rows(linking.phrase_hubs(docs, extractors=("codes", "long"))) == [(1, "abc"), (1, "xylophone"), (3, "nothing")]
        n = spark.createDataFrame([("1", "rule", "T one", "", []), ("2", "rule", "U two", "", []), ("3", "memo", "V", "about T one", [])], "id string, kind string, title string, content string, tags array<string>")
        assert rows(linking.relations(n, detectors=("same_kind",))) == [("1", "2", "same", 0.1), ("2", "1", "same", 0.1), ("3", "1", "related", 0.8)]
    finally:
        for kind, name in (("tagger", "urgent"), ("classifier", "memo"), ("extractor", "codes"), ("extractor", "long"), ("detector", "same_kind")):
            del plugins.KINDS[kind][name]
    with pytest.raises(ValueError, match="no tagger"):
        plugins.tags(F.lit(""), ["urgent"])


def test_profiles_go_round(spark):
    p = profiles.Profile("law", "ko", ("분류", 'say "x"\n'), (r"^\[.*?\]\s*",), min_df=2, max_df_ratio=0.25, enrich_document_content=False, reference_key_property="art", ontology_hints={"rules & terms": "rule", "a.b": "lesson"}, authority_by_kind={"rule": 9}, table_query_hints={"sizes": ["size", "사이즈"]})
    assert profiles.Profile.load(p.save()) == p
    assert profiles.Profile.load(profiles.Profile.generic("en").save()) == profiles.Profile.generic("en")
    with pytest.raises(ValueError, match="no"):
        profiles.Profile.load('name = "x"\nunknown = 1\n')
    docs = spark.createDataFrame([(i, f"header text number word{i} goes here", "policy rules" if i % 2 else "zzz") for i in range(10)] + [(99, None, None)], "doc_id long, text string, cat string")
    got = profiles.generate(docs, "x", category_col="cat")
    assert got.locale == "en" and set(got.stopwords_extra) == {"header", "text", "number", "goes", "here"} | ({"word"} if "word" in got.stopwords_extra else set()) and got.ontology_hints == {"policy rules": "rule"}
    assert profiles.generate(docs.limit(0), "y") == profiles.Profile("y")
    assert {"header", "the"} <= got.stop_words()


def test_column_roles(spark):
    df = spark.createDataFrame([(i, f"name {i}", ["a", "b"][i % 2], f"2024-01-{1 + i % 28:02}", i * 1.5 % 300, None, f"some longer text about thing {i % 70} and more") for i in range(200)], "id long, name string, kind string, day string, price double, void string, note string")
    roles = {r.column: r.role for r in profiles.column_roles(profiles.column_facts(df)).collect()}
    assert roles == {"id": "key", "name": "key", "kind": "category", "day": "date", "price": "key", "void": "empty", "note": "text"} or roles["price"] in ("key", "number")
    facts = {r.column: r for r in profiles.column_facts(df).collect()}
    assert (facts["void"].nulls, facts["name"].shortest, facts["name"].longest, facts["day"].dates, facts["id"].numbers) == (200, 6, 8, 200, 200)


def test_sessions_run_out_and_end(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    start, schema = datetime(2024, 1, 1), "session string, call long, at timestamp, ids array<string>"
    inbox = str(tmp_path / "in")
    put = lambda name, calls: spark.createDataFrame([(s, n, start + timedelta(seconds=at), ids) for s, n, at, ids in calls], schema).write.parquet(f"{inbox}/{name}")

    def run():
        stream = sessions.spend(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(inbox), budget=2, ttl=100, late="10 seconds")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return {(r.session, int((r.at - start).total_seconds())): (r.used, r.left, r.ok, r.fresh) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    first = [("s", 1, 0, ["a", "b"]), ("s", 2, 5, ["b", "c", "c"]), ("t", 3, 6, None)]
    put("1", first)
    got = run()
    assert got == {("s", 0): (1, 1, True, ["a", "b"]), ("s", 5): (2, 0, True, ["c"]), ("t", 6): (1, 1, True, [])}
    # The third call of s is refused, in another run of the stream; after the end a new session begins and has seen nothing.
    put("2", [("s", 4, 50, ["z"]), ("t", 5, 51, ["q"])])
    got = run()
    assert got["s", 50] == (2, 0, False, []) and got["t", 51] == (2, 0, True, ["q"])
    put("3", [("s", 6, 300, ["a"]), ("t", 7, 301, ["q"])])
    got = run()
    assert got["s", 300] == (1, 1, True, ["a"]) and got["t", 301] == (1, 1, True, ["q"]) and len(got) == 7
    batch = {(r.session, r.call): (r.used, r.left, r.ok, r.fresh) for r in sessions.spent(spark.createDataFrame([(s, n, start + timedelta(seconds=at), ids) for s, n, at, ids in [*first, ("s", 4, 50, ["z"])]], schema), 2).collect()}
    assert batch == {("s", 1): (1, 1, True, ["a", "b"]), ("s", 2): (2, 0, True, ["c"]), ("t", 3): (1, 1, True, []), ("s", 4): (2, 0, False, [])}

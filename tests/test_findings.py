"""Small inputs on which queries once differed from their SQL, or took more than their input."""

import difflib
import itertools
import random

import duckdb
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers all queries
from graphloom.functions import text as T
from graphloom.operators import communities, documents, graph, linking, postings
from graphloom.plans import index_catalogue
from graphloom.plans.registry import QUERIES, SQL


def put(spark, folder, **tables):
    """Tables written as the queries read them."""
    for name, (items, schema) in tables.items():
        spark.createDataFrame(items, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def agrees(spark, folder, name):
    """Rows of a query that are the same as its SQL gives."""
    con = duckdb.connect()
    for t in {p.name[: -len(".parquet")] for p in folder.iterdir()}:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    got = sorted(map(tuple, df.collect()), key=repr)
    want = sorted(con.execute(f"select {', '.join(df.columns)} from ({SQL[name]})").fetchall(), key=repr)
    assert got == want
    return got


def test_trimming_takes_blanks_alone(spark, tmp_path):
    """A function given to transform() with two parameters gets the place, too, which trim() took for what to cut off."""
    text = "0997 stands here. 1500 percent 1. 0 and 2024 0"
    put(spark, tmp_path, documents=([(1, text), (2, "  0 x "), (3, "")], "doc_id long, text string"))
    agrees(spark, tmp_path, "document_preview")
    agrees(spark, tmp_path, "extract_facts")
    one = spark.createDataFrame([(text,)], "t string").select(T.facts(F.col("t")), T.preview(F.lit("0a"), F.array("t"))).first()
    assert tuple(one) == (["0997 stands here.", "1500 percent 1.", "0 and 2024 0"], f"0a\n{text}")


def test_locale_mix_counts_texts_with_a_latin_letter(spark, tmp_path):
    """Texts without letters gave a row that the SQL has not, and texts of mostly other letters one less."""
    put(spark, tmp_path, documents=([(1, "a b"), (2, ""), (3, "12 34"), (4, "가나다라 a"), (5, None), (6, "äö"), (7, "ひらがな")], "doc_id long, text string"))
    assert agrees(spark, tmp_path, "locale_mix") == [("latin", 2)]
    mix = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in documents.locale_mix(mix).collect()} == {("latin", 1), ("hangul", 1), ("kana", 1), ("multi", 3)}
    assert {tuple(r) for r in documents.locale_mix(mix, any_letter=True).collect()} == {("latin", 2), ("hangul", 1), ("kana", 1)}
    put(spark, tmp_path, documents=([(1, "12"), (2, "")], "doc_id long, text string"))
    assert agrees(spark, tmp_path, "locale_mix") == []


def test_locales_of_texts(spark, tmp_path):
    texts = ["abc", "", "  　 ", "가나ab", "ひa", "가ひ", "12ab", "123ab", "ab 가나다", "日本ひ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.detect_locale(F.col("t"))).collect()] == ["en", "multi", "multi", "ko", "ja", "ko", "en", "multi", "ko", "multi"]
    put(spark, tmp_path, documents=([(1, "abc"), (2, ""), (3, None), (4, "a1 2"), (5, "a12")], "doc_id long, text string"))
    agrees(spark, tmp_path, "detect_locale")


def test_many_queries_write_no_hits(spark, tmp_path, monkeypatch):
    """Hits of all words, or an index of all texts, were written; now each task keeps the best of each query."""
    words = "the then other an and 가나 x".split()
    docs = [(i, " ".join(words[(i * 7 + j * (i % 3 + 1)) % 7] for j in range(i % 9 + 1)), "\n".join(words[(i + j * j) % 7] + " " + words[(i * j) % 7] for j in range(i % 5))) for i in range(120)]
    rows = postings.fields(spark.createDataFrame(docs, "id long, title string, content string")).repartition(3)
    asked = spark.createDataFrame([(i, " ".join(words[(i + j) % 7] for j in range(i % 4 + 1))) for i in range(12)] + [(90, "the the  an"), (91, "zz"), (92, None), (93, " ")], "query_id long, query string")
    every = postings.scored(*(lambda h: (h[0], postings.plan(asked), h[1], h[2], 10**6))(postings.scan(rows, [r.needle for r in postings.plan(asked).select("needle").distinct().collect()])))
    want = {(r.query_id, r.id): (round(r.score, 9), r["rank"]) for r in every.collect()}
    monkeypatch.setattr(postings.Index, "build", None)
    also = spark.createDataFrame([(i, i * 9) for i in range(12)], "query_id long, id long")
    got = {(r.query_id, r.id): (round(r.score, 9), r["rank"]) for r in postings.scan_many(asked, rows, 4, also, block=5).collect()}
    assert {p for p, (_, rank) in want.items() if rank <= 3} <= set(got)
    assert set(got) >= {(i, i * 9) for i in range(12)} & set(want)
    assert all(want[p][0] == score and (rank == want[p][1] or rank >= 4) for p, (score, rank) in got.items())
    assert postings.bm25_many(asked, 4, rows, needles=3).groupBy("query_id").count().agg({"count": "max"}).first()[0] == 4


def test_many_queries_need_two_scans(spark, monkeypatch):
    """Beyond 16,384 queries there were two more scans for each further block."""
    scans = []
    for name in ("_counted", "_best"):
        monkeypatch.setattr(postings, name, lambda *a, f=getattr(postings, name), name=name: (scans.append(name), f(*a))[1])
    rows = postings.fields(spark.createDataFrame([(1, "w7 w8", "w7 w8\nw9 w19999"), (2, "", "w8")], "id long, title string, content string"))
    asked = spark.range(20_000).select(F.col("id").alias("query_id"), F.format_string("w%d x%d", "id", "id").alias("query"))
    found = postings.scan_many(asked, rows, 3)
    got = {(r.query_id, r.id) for r in found.collect()}
    assert scans == ["_counted", "_best"]
    # Words are found inside words: w1, w19, w199 and w1999 in w19999.
    assert got == {(7, 1), (8, 1), (8, 2), (9, 1), (1, 1), (19, 1), (199, 1), (1999, 1), (19999, 1)}


def test_bounds_leave_out_none_of_the_best(spark):
    """Documents that cannot reach a query's k-th best are left out; what is left is what all scores together give."""
    rng = random.Random(12)
    words = "a aa aaa ana anana the then there 日本 日 é éa longerword longerwords longerwordsandmore x |".split()
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", "\t", "\x0b"]) for _ in range(n))
    docs = [(f"d{i:03d}", text(rng.randint(0, 5)), text(rng.choice([0, 3, 30])), rng.choice([None, ["Ana", "x"]]), rng.choice(["", "longerword the"])) for i in range(400)]
    rows = postings.fields(spark.createDataFrame(docs, "id string, title string, content string, tags array<string>, kw string"), tags_col="tags", keywords=F.col("kw")).repartition(2, "id")
    some = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 1, 2, 2, 3, 3, 4, 4, 5)]
    asked = spark.createDataFrame([*enumerate([*some, some[4], some[6].upper(), " the  then ", "longerwordsandmore longerword", "nowhere", "aa nowhere"])], "query_id int, query string")
    every = postings.scored(*(lambda h: (h[0], postings.plan(asked), h[1], h[2], 10**6))(postings.scan(rows, [r.needle for r in postings.plan(asked).select("needle").distinct().collect()])))
    want, top = {}, {}
    for r in every.orderBy("query_id", "rank").collect():
        want[r.query_id, r.id] = round(r.score, 9)
        top.setdefault(r.query_id, []).append(round(r.score, 9))
    also = spark.createDataFrame([(q, f"d{i:03d}") for q in range(15) for i in (5, 117)], "query_id int, id string")
    for much in (0, 10**9):
        got = {(r.query_id, r.id): (round(r.score, 9), r["rank"]) for r in postings.scan_many(asked, rows, 3, also, much=much).collect()}
        assert all(want[p] == score for p, (score, _) in got.items())
        assert {(q, f"d{i:03d}") for q in range(15) for i in (5, 117)} & set(want) <= set(got)
        assert {q: sorted((s for (p, _), (s, rank) in got.items() if p == q and rank <= 3), reverse=True) for q in top} == {q: x[:3] for q, x in top.items()}


def test_evaluation_reads_the_texts_for_its_queries_once(spark, tmp_path):
    """The queries came from all texts anew wherever they were used; queries of one text each have a document of their own."""
    texts = ["same words here\nand more"] * 3 + ["same words", "", None, "here same\nwords", "other words here"] + ["filler of its own"] * 12
    put(spark, tmp_path, documents=([(i * 50 if i < 8 else i, x) for i, x in enumerate(texts)], "doc_id long, text string"))
    read = []
    index_catalogue.retrieval_evaluation(lambda n: (read.append(n), spark.read.parquet(f"{tmp_path}/{n}.parquet"))[1]).collect()
    assert read.count("documents") == 2
    agrees(spark, tmp_path, "retrieval_evaluation")
    agrees(spark, tmp_path, "bm25_many")


def test_neighbours_resolve_as_all_pairs_do(spark):
    """All pairs of a group were made, sorted and written in each round."""
    rng = random.Random(4)
    for places, wide in ((2, 20), (0, 12), (7, 0.00001)):
        rows = [(f"customer:{i}", i % 2, round(rng.random() * wide, places)) for i in range(60)] + [("customer:x", 0, None)]
        df = spark.createDataFrame(rows, "id string, n int, bal double")
        pairs = df.alias("x").join(df.alias("y"), (F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id")) & F.expr("x.bal is not null and y.bal is not null"))
        pairs = pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.round(1 - F.abs(F.col("x.bal") - F.col("y.bal")) / 100, 6).alias("score"))
        ordered = sorted(map(tuple, pairs.collect()), key=lambda r: (-r[2], r[0], r[1]))
        gone, want = set(), set()
        for a, b, s in ordered:
            if not {a, b} & gone:
                gone.add(b)
                want.add((a, b, s))
        assert {tuple(r) for r in communities.resolve_near(df, ["n"], "bal").collect()} == want


def test_numbered_names_meet_in_small_blocks(spark):
    """Names that differ in their last digits all met in one block."""
    rng = random.Random(8)
    names = [f"Supplier#{i:09d}" for i in range(0, 4000, 37)] + ["".join(rng.choice("ab1") for _ in range(rng.randint(0, 24))) for _ in range(120)]
    df = spark.createDataFrame([(f"n{i:04d}", "k", x) for i, x in enumerate(names)], "id string, kind string, title string")
    first = {}
    for i, x in enumerate(names):
        first.setdefault(x, f"n{i:04d}")
    want = {tuple(sorted((first[x], first[y]))) for x, y in itertools.combinations(sorted(first), 2) if difflib.SequenceMatcher(None, x, y).ratio() >= 0.9}
    want |= {(first[x], f"n{i:04d}") for i, x in enumerate(names) if first[x] != f"n{i:04d}"}
    for most in (400, 20, 0):
        assert {(r.a, r.b) for r in linking.duplicates(df, 0.9, limit=None, most_kept=most).collect()} == want


def test_ranks_are_merged_not_broadcast(spark):
    ends = [(f"n{i}", f"n{i * 7 % 40}") for i in range(1, 120)]
    edges = spark.createDataFrame([(a, b, "part_of", 0.5) for a, b in ends], "source_id string, target_id string, kind string, weight double")
    seeds = spark.createDataFrame([("n1", 3.0), ("n7", 1.0), ("lone", 1.0)], "id string, weight double")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    ranked = graph.personalized_rank(edges, seeds, rounds=13, tol=0.0)
    for df in (ranked, graph.touching(edges, seeds)):
        assert "SortMergeJoin" in plan(df) and "Broadcast" not in plan(df)

    p0 = {"n1": 0.6, "n7": 0.2, "lone": 0.2}
    near = {x for e in ends if p0.keys() & set(e) for x in e} | set(p0)
    w = {}
    for a, b in ends:
        for x, y in ((a, b), (b, a)):
            w[x, y] = w.get((x, y), 0.0) + (a in near) + (b in near)
    out = {a: sum(v for (x, _), v in w.items() if x == a) for a, _ in w}
    want = dict(p0)
    for _ in range(13):
        moved = {}
        for (a, b), v in w.items():
            if v and a in want:
                moved[b] = moved.get(b, 0.0) + want[a] * v / out[a]
        want = {i: 0.15 * p0.get(i, 0.0) + 0.85 * moved.get(i, 0.0) for i in p0.keys() | moved.keys()}
    got = {r.id: r.score for r in ranked.collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)

"""Fuzzy search, choice of evidence and validation on small tables."""

import difflib

from graphloom.operators import evidence, structured


def test_fuzzy_scores(spark):
    rows = [(1, "deploy guide", "how to ship"), (2, "zzz", None), (3, None, "deply now"), (4, "deploy", "x")]
    got = {r.id: r.score for r in evidence.fuzzy(spark.createDataFrame(rows, "id long, title string, content string"), "deploy").collect()}
    want = {}
    for i, title, content in rows:
        title = title or ""
        words = title.split() + (content or "").split()
        ratio = max(difflib.SequenceMatcher(None, "deploy", x).ratio() for x in [title, *words])
        score = ratio + 0.1 * ("deploy" in title)
        if score >= 0.4:
            want[i] = score
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_choice_drops_near_copies_and_limits_documents(spark):
    rows = [(0, 1, 1, 1.0, ["a", "b"]), (0, 2, 2, 0.9, ["a", "b"]), (0, 3, 1, 0.8, ["c"]), (0, 4, 1, 0.7, ["d"]), (0, 5, 3, 0.1, ["e"]), (1, 6, 3, 0.1, [])]
    df = spark.createDataFrame(rows, "query_id int, id long, doc_id long, total double, words array<string>")
    got = sorted((r.query_id, r["rank"], r.id) for r in evidence.choose(df, k=5).collect())
    assert got == [(0, 1, 1), (0, 2, 3), (0, 3, 5), (1, 1, 6)]


def test_validation_reports_every_error(spark):
    df = spark.createDataFrame([(1, "5", "x"), (2, "five", None), (3, None, "")], "id long, size string, name string")
    got = {r.id: r.errors for r in structured.validate(df, "id", [("size", "int", False), ("name", "str", True)]).collect()}
    assert got == {2: "size is not int; missing name", 3: "missing name"}

"""Hard negatives, whitening and quality rules against brute force, on small tables with awkward rows."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import hard_negatives, quality, whitening

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, id string, x int, v string"


def awkward(seed, n=260, d=12):
    """Clustered vectors with copies, nulls, non-finite and empty ones, another length, and null ids and labels."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, d)) * np.linspace(2, 0.1, d)
    rows = [(i, [float(np.float32(c)) for c in centres[i % 4] + rng.normal(size=d) * 0.4], int(rng.integers(0, 3))) for i in range(n)]
    rows += [(i, rows[5][1], 1) for i in range(300, 340)]
    rows += [(400, None, 1), (500, [NAN] * d, 1), (600, [INF] + [0.0] * (d - 1), 0), (700, [None] + [1.0] * (d - 1), 0), (800, [0.0] * d, 2), (900, [], 1), (901, [], 1), (902, [], 0)]
    rows += [(1000, [1.0, 2.0], 0), (1001, [1.0, 2.5], 0), (1002, [0.5, 0.5], 1), (1100, rows[7][1], None), (None, rows[8][1], 1), (1200, [1e30] * d, 1), rows[9], rows[100]]
    return [(*r, "clash", 3, "w") for r in rows]


@pytest.fixture(scope="module")
def vectors(spark):
    rows = awkward(3)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def integers(v, scale=256):
    return [math.floor(c * scale) for c in v]


def usable(rows):
    """Rows by id that take part in mining, as integers."""
    out = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v) or sum((256 * c) ** 2 for c in v) >= 4e18:
            continue
        out[i] = min(out.get(i, (str(label), integers(v))), (str(label), integers(v)))
    return out


def mined(rows):
    held, out = usable(rows), []
    for a, (label, x) in held.items():
        if a % 100:
            continue
        score = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), i, other) for i, (other, y) in held.items() if i != a and len(x) == len(y))
        for p, i, _ in [s for s in score if s[2] == label][:5]:
            fit = [s for s in score if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:10]
            out += [(a, i, r, n, -p, -s) for r, (s, n, _) in enumerate(fit, 1)]
    return sorted(out)


def test_hard_negatives(spark, vectors, monkeypatch):
    rows, df = vectors
    want = mined(rows)
    assert len(want) > 50
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = hard_negatives.mine(df, F.col("id") % 100 == 0)
    assert found.columns == cols
    assert sorted(map(tuple, found.collect())) == want
    assert hard_negatives.mine(df.limit(0), F.col("id") % 100 == 0).count() == 0


def test_hard_negatives_discard_early_and_in_shards(spark):
    """More shards than one, more candidates than a step, and rows that no window takes."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(c) for c in rng.normal(size=8) * [3, 2, 1, 1, 0.3, 0.2, 0.1, 0.1]], int(i % 3), "", 0, "") for i in range(5000)]
    df = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    got = sorted(map(tuple, hard_negatives.mine(df, F.col("id") % 1000 == 0).collect()))
    held = usable(rows)
    ids = np.array(sorted(held))
    x = np.array([held[i][1] for i in ids])
    label = np.array([held[i][0] for i in ids])
    want = []
    for a in range(0, 5000, 1000):
        s = x @ x[a]
        order = [i for i in np.lexsort((ids, -s)) if i != a]
        for p in [i for i in order if label[i] == label[a]][:5]:
            fit = [i for i in order if label[i] != label[a] and 30 * s[p] <= 100 * s[i] <= 90 * s[p]][:10]
            want += [(a, int(ids[p]), r, int(ids[i]), int(s[p]), int(s[i])) for r, i in enumerate(fit, 1)]
    assert got == sorted(want)


def test_rotated_search_discards_before_the_last_axis():
    """Most pairs never reach the integer products, and bounds hold for vectors of very unlike sizes."""
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(6000, 32)) * np.geomspace(1e6, 1, 32)).astype(np.int64)
    shard = hard_negatives.Rotated(np.arange(6000), np.array(["a"] * 6000, object), x)
    seen = []
    verified = shard._verified
    shard._verified = lambda anchors, windows, best, least, at, lo, k: (seen.append(len(at[0])), verified(anchors, windows, best, least, at, lo, k))
    anchors = x[:40]
    got = shard.search(anchors, [[(hard_negatives.LOW, hard_negatives.HIGH), (-(10**12), 10**9)]] * 40, [np.ones(6000, bool)] * 40, 3, np.arange(40))
    assert sum(seen) < 0.2 * 40 * 6000
    for i in range(40):
        s = x @ anchors[i]
        order = [j for j in np.lexsort((np.arange(6000), -s)) if j != i]
        inside = [j for j in order if -(10**12) <= s[j] <= 10**9][:3]
        assert got[i][0][0].tolist() == order[:3]
        assert got[i][1][0].tolist() == inside


def test_jacobi_against_lapack():
    rng = np.random.default_rng(2)
    for d in (1, 2, 3, 7, 16, 33):
        a = rng.normal(size=(3 * d, d)) * np.geomspace(1, 1e-9, d)
        size, axes = whitening.jacobi(np.linalg.qr(a, mode="r"))
        assert np.allclose(size, np.linalg.svd(a, compute_uv=False), rtol=1e-5, atol=0)
        assert np.allclose(axes @ axes.T, np.eye(d), atol=1e-12)
        assert np.allclose(np.linalg.norm(a @ axes.T, axis=0), size, rtol=1e-6)


def whitened_rows(rows, d):
    return [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v, *_ in rows if v is not None and len(v) == d and all(c is not None and math.isfinite(c) and abs(c) * 1024 < 2**52 for c in v)]


def test_whitening(spark, vectors, monkeypatch):
    rows, df = vectors
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    got = [r for r in whitening.whiten(df).collect()]
    for d in (12, 2):
        own = whitened_rows(rows, d)
        x = np.array([v for _, v in own], float)
        n, total = len(own), [sum(v[j] for _, v in own) for j in range(d)]
        c = np.array([[float(Fraction(e) - Fraction(t, n)) for e, t in zip(v, total, strict=True)] for _, v in own])
        value, vec = np.linalg.eigh(c.T @ c / n)
        value, vec = value[::-1], vec[:, ::-1]
        k = min(8, d)
        mine = [r for r in got if r.n == n]
        assert len(mine) == n * k and len(x) == n
        want = sorted(((i is not None, i or 0), sum((n * e - t) ** 2 for e, t in zip(v, total, strict=True)), w) for (i, v), w in zip(own, (c @ vec[:, :k] / np.sqrt(value[:k])).tolist(), strict=True))
        by_row = {}
        for r in sorted(mine, key=lambda r: r.component):
            by_row.setdefault((r.vec_id is not None, r.vec_id or 0, r.deviation), []).append(r)
        found = sorted((k[:2], k[2], [r.whitened for r in of if r.component <= 8]) for k, of in by_row.items())
        # Rows that repeat id and vector fall together above.
        whole = {(a, b): w for a, b, w in want}
        assert {(a, b) for a, b, _ in found} == set(whole)
        sign = None
        for a, b, w in found:
            w = np.array(w).reshape(k, -1)[:, 0]
            o = np.array(whole[a, b])
            sign = np.sign(w * o) if sign is None else sign
            assert np.allclose(w, o * sign, rtol=1e-7, atol=1e-8)
        share = {r.component: r.explained for r in mine}
        assert np.allclose([share[j + 1] for j in range(k)], value[:k] / value.sum(), rtol=1e-9)
        assert {r.identity_error for r in mine} and max(r.identity_error for r in mine) < 1e-9
    assert whitening.whiten(df.limit(0)).collect() == []


def test_whitening_without_variance_and_beyond_a_long(spark):
    same = spark.createDataFrame([(1, [0.5, 0.25]), (None, [0.5, 0.25])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, whitening.whiten(same).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()), key=str) == sorted(
        [(i, k, 2, 0, None, 0.0, 0.0) for i in (1, None) for k in (1, 2)], key=str
    )
    wide = spark.createDataFrame([(2**60 + 1, [1e9]), (2, [-1e9]), (None, [1.5])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in whitening.whiten(wide).collect()}
    x = [math.floor(1024 * c) + 100_000 for c in (1e9, -1e9, 1.5)]
    want = [(3 * v - sum(x)) ** 2 for v in x]
    assert [got[i].deviation for i in (2**60 + 1, 2, None)] == [v if v < 2**63 else None for v in want]
    assert max(r.identity_error for r in got.values()) < 1e-9


RNG = random.Random(8)
TEXTS = [
    None, "", " \n\t", "one", "nine words are not enough to be kept here", " ".join(f"w{i}" for i in range(10)), "a b c d e f " * 2, ("x " * 40).strip(), "same line here\n" * 12, "a\x0bb\x0cc d\r\ne f g h i j k\x1c l m",
    " ".join(f"w{i}%%%" for i in range(30)), " ".join(f"w{i} |" for i in range(30)), "\n".join(f"- point {i} of the list" for i in range(9)), "\n".join(f"line {i} goes on ..." for i in range(9)), "1 2 3 4 5 6 7 8 9 10 11 12 13", "日本語のテキスト " * 3 + "ここ で す そ れ は と て も い い",
    "y" * 5000, " ".join(RNG.choice("ab cd ef gh ij".split()) for _ in range(3000)), "clean text goes on and on in words that never come twice in the same order at all",
]


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    win = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {p for i in range(len(w) - 4) if win[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)
    return n, n[0] < 10 or 100 * n[4] > 20 * n[0], lines, w


def judged(t):
    (n, chars, symbols, dup, rep), failed, lines, w = brute(t)
    bad = failed or symbols * 10 > n or not 2 * n <= chars <= 25 * n or 2 * dup > len(lines) or 2 * sum(bool(re.search("[A-Za-z]|[^\x00-\x7f]", x)) for x in w) < n
    many = len(lines) >= 5
    return not (bad or many and sum(bool(re.match(r"[ \t]*[-*•]", x)) for x in lines) * 10 > 9 * len(lines) or many and sum(bool(re.search(r"(\.\.\.|…)[ \t\r]*$", x)) for x in lines) * 10 > 3 * len(lines))


def test_quality_rules(spark):
    rows = [(i, t, 1, "k", 5) for i, t in enumerate(TEXTS)] + [(3, "one", 1, "k", 5), (None, TEXTS[-1], 1, "k", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept string, rejects int").repartition(3)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = quality.cascade(docs, facts=counts)
    assert sorted((tuple(r) for r in got.select("doc_id", *counts, "kept").collect()), key=str) == sorted(((i, *brute(t)[0], judged(t)) for i, t, *_ in rows), key=str)
    by = {(r.doc_id, r.rejected_by is None) for r in got.collect()}
    assert by == {(i, judged(t)) for i, t, *_ in rows}
    assert quality.cascade(docs.limit(0)).count() == 0
    # No order changes a verdict, nor does a cascade without rules drop a row.
    for rules in (quality.RULES[::-1], []):
        want = {(i, not rules or judged(t)) for i, t, *_ in rows}
        assert {(r.doc_id, r.kept) for r in quality.cascade(docs, rules).collect()} == want


def test_cascade_orders_by_rejection_per_cost_and_stops(spark):
    rules = {r.name: r for r in quality.RULES}
    chosen = [rules["few_letters"], rules["symbols"], rules["few_words"], rules["bullets"]]
    cost = dict.fromkeys(quality.FACTS, 1.0) | {"words": 2.0, "n_letter_words": 10.0, "n_symbols": 1.0, "n_words": 0.1, "lines": 5.0}
    rejects = np.zeros((100, 4), bool)
    rejects[:60, 0] = True  # 60 for 12.1
    rejects[:40, 1] = True  # 40 for 3.1
    rejects[80:90, 2] = True  # 10 for 2.1, then for nothing
    rejects[:50, 3] = True  # 50 for 7, of which 10 are left after symbols
    assert [r.name for r in quality.ordered(chosen, cost, rejects)] == ["symbols", "few_words", "few_letters", "bullets"]
    # Facts at hand cost nothing.
    assert quality.ordered(chosen, cost, rejects, ["n_letter_words", "n_words"])[0].name == "few_letters"
    # A fact that no rule before the rejecting one asks for is never made.
    facts = quality.Facts("few %%%")
    assert rules["few_words"].rejects(facts) and "n_symbols" not in vars(facts) and "lines" not in vars(facts)
    docs = spark.createDataFrame([(i, "a b" if i % 2 else "%% " * 20) for i in range(50)], "doc_id long, text string")
    took, seen = quality.measured(docs, chosen, sample=20)
    assert 0 < len(seen) <= 50 and set(took) == set(quality.asked([x for r in chosen for x in r.needs]))

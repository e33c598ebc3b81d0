"""Louvain, kept labels, greedy resolution and tables by key against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import communities, graph
from graphloom.operators.keyed import Keyed
from graphloom.operators.lineage import written

EDGE = "source_id string, target_id string, kind string, weight double"


def table(spark, edges):
    return spark.createDataFrame([(a, b, "related", float(w)) for a, b, w in edges], EDGE)


def quality(edges, label, resolution=1.0):
    both = [(a, b, w) for a, b, w in edges] + [(b, a, w) for a, b, w in edges]
    whole = sum(w for *_, w in both)
    inside = sum(w for a, b, w in both if label[a] == label[b])
    total = {}
    for a, _, w in both:
        total[label[a]] = total.get(label[a], 0) + w
    return inside / whole - resolution * sum(t * t for t in total.values()) / whole**2


def partitions(items):
    """All ways to part a list."""
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for i in range(len(rest)):
            yield [*rest[:i], [items[0], *rest[i]], *rest[i + 1 :]]


def clustered(seed, sizes=(4, 3, 3)):
    """Dense groups with a few weak edges between them, a loop and a repeated edge."""
    rng = random.Random(seed)
    groups = [[f"{'abcdef'[i]}{j}" for j in range(n)] for i, n in enumerate(sizes)]
    edges = [(x, y, rng.choice([1, 2])) for g in groups for x, y in itertools.combinations(g, 2)]
    edges += [(rng.choice(groups[i]), rng.choice(groups[j]), 0.5) for i, j in itertools.combinations(range(len(sizes)), 2)]
    return [*edges, ("a0", "a0", 0.5), edges[0]]


@pytest.mark.parametrize("seed", [1, 2])
def test_louvain_finds_the_best_parting_of_small_graphs(spark, seed):
    edges = clustered(seed)
    names = sorted({x for a, b, _ in edges for x in (a, b)})
    best = max(quality(edges, {x: i for i, g in enumerate(p) for x in g}) for p in partitions(names))
    df = table(spark, edges)
    found = communities.louvain(df)
    label = {r.id: r.label for r in found.collect()}
    assert set(label) == set(names) and all(label[x] == min(y for y in names if label[y] == label[x]) for x in names)
    assert abs(quality(edges, label) - best) < 1e-9
    assert abs(communities.modularity(df, found).first()[0] - best) < 1e-9
    assert communities.louvain(df.limit(0)).count() == 0


def test_louvain_of_stars_and_chains_joins_many_at_once(spark):
    star = [("hub", f"l{i:03}", 1.0) for i in range(60)] + [(f"c{i}", f"c{i + 1}", 1.0) for i in range(12)]
    df = table(spark, star)
    label = {r.id: r.label for r in communities.louvain(df).collect()}
    assert len({label[x] for x in label if x[0] in "hl"}) == 1
    plain = {r.id: r.label for r in graph.communities(df, 20).collect()}
    assert quality(star, label) >= quality(star, plain) - 1e-12


def rings(names):
    return [(f"{n}{i}", f"{n}{j}", 1.0) for n in names for i, j in itertools.combinations(range(4), 2)]


def test_labels_are_updated_around_changes_alone(spark, tmp_path):
    old = rings("abcdefgh")
    store = communities.Labels(spark, str(tmp_path / "labels"), buckets=8)
    store.start(graph.communities(table(spark, old)))
    before = {r.id: r.label for r in store.read().collect()}
    # A new group, a node that leaves a group, one that loses all edges, and one that joins another.
    now = [e for e in old if "a3" not in e[:2] and "b2" not in e[:2]] + rings("z") + [("b2", f"c{i}", 1.0) for i in range(4)]
    changed = [e for e in now if e not in old] + [e for e in old if e not in now]
    moved = store.update(table(spark, now), table(spark, changed).select("source_id", "target_id"))
    full = {r.id: r.label for r in graph.communities(table(spark, now)).collect()}
    assert {r.id: r.label for r in store.read().collect()} == full
    assert {(r.id, r.label, r.was) for r in moved.collect()} == {(x, full.get(x), before.get(x)) for x in {*full, *before} if full.get(x) != before.get(x)}
    last = store.table.commits()[-1]
    assert not last.base and len(last.buckets) < 8
    # A change inside a community moves nothing, and writes no bucket.
    assert store.update(table(spark, now), table(spark, [("d0", "d1", 1)]).select("source_id", "target_id")).count() == 0
    assert store.table.commits()[-1].buckets == []


def one_by_one(pairs, access):
    """The rule, pair after pair."""
    access, gone, out = dict(access), set(), set()
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a in gone or b in gone or a not in access or b not in access:
            continue
        kept, lost = (b, a) if access[b] > access[a] else (a, b)
        access[kept] += access[lost]
        gone.add(lost)
        out.add((kept, lost, s))
    return out


def test_greedy_resolution_equals_the_rule_on_many_graphs(spark):
    rng, pairs, nodes, want = random.Random(3), [], [], set()
    for g in range(1000):
        names = [f"{g}-{i}" for i in range(rng.randint(2, 7))]
        access = {x: rng.randint(0, 3) for x in names}
        own = {p: rng.choice([0.85, 0.9, 0.95, 1.0]) for p in itertools.combinations(names, 2) if rng.random() < 0.6}
        own = [(a, b, s) for (a, b), s in own.items()] + ([(names[1], "missing", 1.0)] if g % 9 == 0 else [])
        pairs, nodes = pairs + own, nodes + list(access.items())
        want |= one_by_one(own, access)
    df = spark.createDataFrame(pairs, "a string, b string, score double")
    n = spark.createDataFrame(nodes, "id string, access_count long")
    assert {tuple(r) for r in communities.resolve(df, n).collect()} == want
    assert communities.resolve(df.limit(0), n).count() == 0
    # A chain of likenesses does not join unlike ends: b goes to a, so c, like b alone, stays.
    chain = spark.createDataFrame([("a", "b", 0.95), ("b", "c", 0.9)], "a string, b string, score double")
    three = spark.createDataFrame([(x, 0) for x in "abc"], "id string, access_count long")
    assert [tuple(r) for r in communities.resolve(chain, three).collect()] == [("a", "b", 0.95)]


def test_merging_follows_chains(spark):
    nodes = spark.createDataFrame([(x, "entity", x.upper(), f"text {x}", [x], 1, 1, 0, 0.5) for x in "abcxyzq"] + [("keep", "entity", "K", " as it is ", None, 1, 1, 0, 0.5)], "id string, kind string, title string, content string, tags array<string>, access_count long, success_count long, failure_count long, vitality double")
    same = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "z"), ("z", "x"), ("q", "nowhere")], "old string, new string")
    got = {r.id: r for r in graph.merge_contents(nodes, same).collect()}
    assert set(got) == {"c", "x", "q", "keep"}
    assert got["c"].content == "text c\n\ntext a\n\ntext b" and got["c"].access_count == 3 and got["x"].content == "text x\n\ntext y\n\ntext z"
    assert got["keep"].content == " as it is " and got["keep"].tags is None and got["q"].content == "text q"
    edges = table(spark, [("a", "x", 1), ("b", "y", 2), ("k", "a", 1)])
    assert sorted(tuple(r) for r in graph.merge_nodes(edges, same).collect()) == [("c", "x", "related", 2.0), ("k", "c", "related", 1.0)]


def test_keyed_table(spark, tmp_path):
    schema = "id long, v string"
    make = lambda rows: spark.createDataFrame(rows, schema)
    t = Keyed(spark, str(tmp_path / "t"), ["id"], schema, buckets=4)
    read = lambda **k: sorted(map(tuple, t.read(**k).collect()))
    assert read() == [] and t.version() == 0 and t.meta() == {}
    t.write(make([(i, "a") for i in range(20)]), base=True, meta={"n": 1})
    t.write(make([(3, "b"), (100, "n"), (None, "null key")]), make([(5, None), (999, None)]))
    want = sorted([(i, "b" if i == 3 else "a") for i in range(20) if i != 5] + [(100, "n")])
    assert read() == want and t.meta() == {"n": 1}
    assert read(version=1) == [(i, "a") for i in range(20)]
    some = t.touched(make([(3, None)]))
    assert len(some) == 1 and all(r in want for r in read(buckets=some)) and (3, "b") in read(buckets=some)
    plan = t.read(buckets=some)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "_bucket" in plan
    # A write that failed before its commit counts for nothing, and its place is written again.
    make([(1, "lost")]).withColumn("_gone", F.lit(False)).withColumn("_bucket", F.lit(0)).write.partitionBy("_bucket").parquet(str(tmp_path / "t/rows/v3"))
    assert read() == want
    t.write(make([(3, "c")]))
    before = read()
    assert (3, "c") in before and (1, "lost") not in before
    full = t.compact(most=0)
    assert full and read() == before
    assert t.clean() > 0 and read() == before


def test_edges_at_voting_nodes_are_written_once(spark, monkeypatch):
    """Rounds in which no more nodes begin to vote don't go over all edges again."""
    names = []
    monkeypatch.setattr(communities, "written", lambda df, name: names.append(name) or written(df, name))
    edge = "source_id string, target_id string, weight double"
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("x", "y", 1.0), ("y", "z", 1.0), ("x", "z", 1.0)], edge)
    labels = spark.createDataFrame([("a", "a"), ("b", "a"), ("x", "x"), ("y", "x"), ("z", "x")], "id string, label string")
    new = spark.createDataFrame([("b", "c"), ("a", "c")], "source_id string, target_id string")
    assert {tuple(r) for r in communities.relabelled(edges, labels, new, 5).collect()} == {("c", "a", None)}
    assert names.count("fresh") > 1 and names.count("around") == 1

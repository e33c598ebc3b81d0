"""The pipeline's stages on the smallest table."""

import random

import numpy as np
import pandas as pd

from graphloom.llm import jaccard_join, secrets
from graphloom.llm import pipeline as corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, stages = zip(*corpus_pipeline.STAGES, strict=True)
    assert names == ("toxicity", "near_copies", "decontamination", "secrets", "packing")
    before = docs
    for stage in stages[:3]:
        after = corpus_pipeline.stored(stage(spark, before, SF), "test")
        assert after.columns == docs.columns
        kept, had = ({r.doc_id for r in d.select("doc_id").collect()} for d in (after, before))
        assert kept <= had and len(kept) > 0.5 * len(had)
        before = after
    clean = corpus_pipeline.redact_secrets(spark, before, SF)
    assert clean.columns == docs.columns and clean.count() == before.count()
    assert all(not secrets.find(r.text or "")[0] for r in clean.collect())
    assert {r.doc_id for r in corpus_pipeline.pack(spark, clean, SF).select("doc_id").distinct().collect()} == kept


def _prose(seed, n):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def _near(text, at):
    return " ".join("edit" if i == at else w for i, w in enumerate(text.split()))


def test_near_copies_of_null_and_repeated_ids(spark):
    groups = {i: _prose(i, 200) for i in range(10, 18)}
    rows, want = [], []
    for i, t in groups.items():  # a real id among null ids: the real one stays
        rows += [(None, _near(t, 100)), (i, t), (None, _near(t, 150)), (i + 100, _near(t, 50))]
        want.append((i, t))
    lone = [(None, _prose(s, 60)) for s in range(30, 36)]
    empty = [(None, ""), (None, ""), (3, None)]
    same_id = [(9, _prose(40, 50)), (9, _prose(41, 50))]
    twice = [(7, _prose(42, 50))]
    rows += lone + empty + same_id + twice + twice
    want += lone + empty + same_id + twice
    pair = _prose(50, 200)
    pairs = [(None, _near(pair, 60)), (None, _near(pair, 120)), (None, _near(pair, 120))]
    docs = spark.createDataFrame(rows + pairs, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()]
    kept = [r for r in got if r in pairs]
    assert len(kept) == 1
    assert sorted((r for r in got if r not in pairs), key=repr) == sorted(want, key=repr)
    ids = {(r.doc_id, r.n_shingles > 0, r.component_id) for r in jaccard_join.link_documents(docs).collect()}
    assert {c for i, some, c in ids if i is None} == {None, *groups}
    assert all(c == (i - 100 if i > 100 else i) for i, _, c in ids if i is not None)


def test_decontamination_of_null_and_repeated_ids(spark, tmp_path):
    item = _prose(60, 40)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [(None, _prose(61, 40)), (4, _prose(62, 40)), (None, ""), (5, None)]
    docs = spark.createDataFrame([(None, item), (4, item), *clean], "doc_id long, text string")
    got = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(clean, key=repr)


def test_stages_against_plain_python(spark, tmp_path):
    """Near copies at 0.8 on five words, contamination and secrets of a planted table, with columns named as the operators' own."""
    rng, item = random.Random(12), _prose(70, 60)
    rows = []
    for i in range(30):
        base = _prose(100 + i, rng.randint(5, 120)).split()
        rows.append((i, " ".join(base)))
        for j in range(rng.randint(0, 3)):
            w = list(base)
            for at in rng.sample(range(len(w)), min(len(w), rng.randint(0, 4))):
                w[at] = f"x{i}y{j}z{at}"
            rows.append((1000 + 10 * i + j, " ".join(w)))
    rows += [(5000, item), (5001, f"{_prose(71, 400)} {' '.join(item.split()[:14])}"), (5002, "password = hunter2hunter2 and more"), (5003, None), (5004, "")]
    docs = spark.createDataFrame([(i, t, 0.25, 1, 7, "c", "r") for i, t in rows], "doc_id long, text string, score double, predicted int, rk long, comp string, row string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i == 3)) for i in range(30)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    sets = {i: {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    kept = corpus_pipeline.stored(corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)), "test")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in sets if root(i) == i)
    assert {(r.score, r.predicted, r.rk, r.comp, r.row) for r in kept.collect()} == {(0.25, 1, 7, "c", "r")}
    clean = corpus_pipeline.drop_contaminated(spark, kept, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} - {r.doc_id for r in clean.collect()} == {5000}  # 14 of 414 words are less than a twentieth
    told = {r.doc_id: r.text for r in corpus_pipeline.redact_secrets(spark, clean, str(tmp_path)).collect()}
    assert told[5002] == "[secret] and more" and told[5003] is None and told[5004] == "" and told[0] == dict(rows)[0]
    safe = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert safe.columns == docs.columns and safe.where("score = 0.25").count() == safe.count() > 0.9 * len(rows)


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0


def test_workers_free_what_other_tasks_kept(spark):
    """A worker that has packed drops the packing's table when a task of another kind starts, and packs again as before."""
    from graphloom.llm import packing, toxicity, workers

    def told(name):
        def each(batches):
            import pandas as pd

            for _ in batches:
                pass
            yield pd.DataFrame({"kept": [",".join(workers._KEPT)]})

        return spark.range(1).coalesce(1).mapInPandas(workers.thrifty(each, keeps=name), "kept string").first().kept

    docs = spark.createDataFrame([(i, f"word{i} is here") for i in range(2500)], "doc_id long, text string").coalesce(1)
    first = packing.pack_documents(docs).collect()
    # One worker serves these one after the other.
    assert told(packing.TOKENIZER) in ("", packing.TOKENIZER) and told(None) == ""
    model = toxicity.Model(np.zeros(1 << toxicity.BITS, np.float32), 0.0)
    assert {r.s for r in docs.select(toxicity.score_column(spark, model, docs["text"]).alias("s")).collect()} == {0.5}
    assert packing.pack_documents(docs).collect() == first


def test_batches_are_worked_on_in_parts():
    from graphloom.llm import workers

    b = pd.DataFrame({"x": range(2500)})
    assert [len(p) for p in workers.parts(b)] == [1000, 1000, 500] and [len(p) for p in workers.parts(b[:0])] == [0]
    workers.kept("one", lambda: [1])
    workers.kept("two", lambda: [2])
    assert list(workers._KEPT) == ["two"] and list(workers.thrifty(lambda bs: (len(x) for x in bs))(iter([b]))) == [2500] and not workers._KEPT

"""The training-data operators against brute force, on small tables with awkward rows."""

import collections
import hashlib
import itertools
import json
import random
import re
import zlib

import numpy as np
import pytest

from graphloom.llm import decontaminate, jaccard_join, nearest, packing, page_text, personal_data, secrets, substring_dedup, token_counts, toxicity
from graphloom.llm.keys import components

RNG = random.Random(5)
VOCAB = [a + b for a in ("th", "an", "ér", "on", "Re", "st") for b in ("le", "in", "o", "ou", "it9", "ß")]
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def prose(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


def corpus():
    """Nulls, empty and long texts, copies, near copies, a shared passage, and a repeated row."""
    passage, base, near = prose(50), prose(120), prose(200).split()
    texts = [None, "", " \n\t", "one", "two words", prose(3), "a" * 3000, base, base, base + " more words here", prose(3000), "\x1c odd\x00 ​ text", "İΣ 'S it's <|endoftext|>"]
    texts += [f"{prose(60)} {passage} {prose(20)}" for _ in range(3)] + [f"{passage} {passage}"]
    for i in range(6):
        w = list(near)
        w[20 * i + 7] = f"edit{i}"
        texts.append(" ".join(w))
    texts += [prose(RNG.randint(1, 80)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, rows[7], (None, "no id at all"), (None, base)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 9, "x") for i, t in ROWS], "doc_id long, text string, h long, n string").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def table(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(token_counts.tokenizer_path(token_counts.TOKENIZER))
    want = []
    for i, t in ROWS:
        n = len(tool.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 50))
    assert table(token_counts.count_tokens(docs, limit=50), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert token_counts.count_tokens(empty(spark)).count() == 0


def test_token_chunks_and_flush():
    tool = token_counts.Transducer(token_counts.tokenizer_path(token_counts.TOKENIZER))
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(token_counts.tokenizer_path(token_counts.TOKENIZER))
    texts = ["x" * 5000, prose(2000), "''s 'sabc 'll're!? 12½", "ab" * 1200 + " end", "".join(RNG.choice("abcdefgh") for _ in range(4000))]
    want = [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    assert tool.count(texts).tolist() == want
    tool._reset()
    assert tool.count(texts).tolist() == want


def low(t):
    return (t or "").translate(str.maketrans(decontaminate.UPPER, decontaminate.LOWER))


def test_decontamination(spark, docs):
    shared = [t for _, t in ROWS if t and len(t.split()) > 100]
    items = [(0, " ".join(shared[0].split()[5:40])), (1, None), (2, "!!"), (3, "two WORDS"), (4, prose(30)), (10, " ".join(shared[0].split()[30:44])), (11, "one"), (3, "two WORDS"), (None, " ".join(shared[1].split()[:20]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = word.findall(low(t))
        n = min(13, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[a : a + n])].add(i)
    want = []
    for i, t in ROWS:
        w = word.findall(low(t))
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[a : a + n]))) is not None:
                    found |= x
                    hit[a : a + n] = [True] * n
        names = sorted(str(x) for x in found if x is not None)
        want.append((i, len(w), sum(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    got = table(decontaminate.decontaminate(docs, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(want, key=repr)
    assert decontaminate.decontaminate(empty(spark), bench).count() == 0
    named = bench.selectExpr("'item ' || item_id as item_id", "text")
    by_name = {(r.doc_id, r.n_hit, r.n_items) for r in decontaminate.decontaminate(docs, named).collect()}
    assert by_name == {(i, hit, n) for i, _, hit, n, _, _ in got}
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_personal_data_patterns_and_field(spark):
    bits = ["a", "@", ".", "1", "23", "+", "-", " ", "255", "4111 1111 1111 1111", "b.c", "%", "(", "é", "x@y.z", "1.2.3.4", "+1 (555) 123-4567"]
    for _ in range(2000):
        x = "".join(RNG.choice(bits) for _ in range(RNG.randint(0, 30)))
        want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
        want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
            d = re.sub("[^0-9]", "", m[0])
            want += [("card", *m.span())] * (12 <= len(d) <= 19 and personal_data.luhn(d))
        want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert sorted(personal_data.patterns(x)) == sorted(want)
    field = personal_data.trained()
    table_ = personal_data.labelled_table(200, 99)
    right = [(y == t).all() for y, (_, t) in zip(field.decode([c for c, _ in table_]), table_, strict=True)]
    assert np.mean(right) > 0.95
    base, added = personal_data.find("please call (361) 555-8283 now", field)
    assert not base and [k for k, _, _ in added] == ["phone"]
    df = spark.createDataFrame([(1, None), (2, "mail a.b@c.de now"), (2, "mail a.b@c.de now"), (3, "")], "doc_id long, text string")
    got = table(personal_data.find_personal_data(df), "doc_id", "n_email", "spans")
    assert got == [(1, 0, ""), (2, 1, "email:5:13"), (2, 1, "email:5:13"), (3, 0, "")]
    assert personal_data.find_personal_data(empty(spark)).count() == 0


def _long_runs():
    pad = "abcdef" * 40
    phone, mail = "(361)555-8283", "jane[at]mail.example"
    yield '{"a":"%s","phone":"%s","b":[1,2]}' % (pad, phone), phone
    yield '{"a":"%s","mail":"%s"}' % (pad, mail), mail
    yield f"{pad},17,{phone},18", phone
    yield f"q={pad}&call=%28361%29555-8283&x=1", "%28361%29555-8283"
    yield f"q={pad}&call=%28361%29%20555-8283&x=1", "%28361%29%20555-8283"
    yield "\u6587\u5b57" * 80 + phone + "\u6587\u5b57" * 80, phone
    yield f"{pad}/{phone}/{pad}", phone
    yield pad + phone + pad, phone


@pytest.mark.parametrize(("run", "held"), [*_long_runs()])
def test_personal_data_in_long_runs(run, held):
    for text, off in ((run, 0), (f"some words {run} and more", 11)):
        _, added = personal_data.find(text, personal_data.trained())
        at = off + run.index(held)
        assert [(s, e) for _, s, e in added] == [(at, at + len(held))], added


def test_personal_data_sees_whole_neighbours_and_long_hosts():
    far = "call" + " " * 500 + "(361) 555-8283"
    chain = personal_data.chains(far)
    assert chain[0][0][0] == "call" and [t for t, _, _ in chain[0][1:3]] == ["(361)", "555-8283"]
    wide = "x" * 90 + " (361)555-8283 " + "y" * 90
    assert [t for t, _, _ in personal_data.chains(wide)[0]] == ["x" * 90, "(361)555-8283", "y" * 90]
    host = ".".join(["mail"] * 9 + ["a" * 70])
    run = "z" * 130 + ",jane[at]" + host
    assert "jane[at]" + host in [t for c in personal_data.chains(run) for t, _, _ in c]
    assert personal_data.chains("q" * 200 + "1" * 90 + "q" * 10)[0][1][0] == "1" * 90


def best_path(field, chain):
    """The best labels of a chain by trying all."""
    score, _, _ = field.scores([chain])
    return max(itertools.product(range(score.shape[2]), repeat=len(chain)), key=lambda y: sum(score[0, i, v] for i, v in enumerate(y)) + sum(field.step[a, b] for a, b in zip(y, y[1:], strict=False)))


def test_field_decodes_many_texts_as_each_alone():
    field = personal_data.trained()
    chains = [c[:4] for c, _ in personal_data.labelled_table(40, 5)]
    assert [tuple(y) for y in field.decode(chains, cells=17)] == [best_path(field, c) for c in chains]
    texts = [prose(RNG.randint(0, 9)) + RNG.choice(["", " call (361) 555-8283 or +1 (555) 123-4567", " mail jane[at]mail.example", " 4111-1111-1111-1111"]) + " " + prose(3) for _ in range(60)]
    assert list(personal_data.find_all(texts, field, most=300)) == [personal_data.find(t, field) for t in texts]


@pytest.mark.parametrize("name", ["personal", "secrets"])
def test_spans_of_empty_tables_and_clashing_columns(spark, name):
    find = personal_data.find_personal_data if name == "personal" else secrets.find_secrets
    rows = [(1, "mail a.b@c.de, token=abcdef1234567890", "x", 7), (None, None, None, None), (1, "mail a.b@c.de, token=abcdef1234567890", "x", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_email int")
    got = sorted(map(tuple, find(df).select("doc_id", "spans").collect()), key=str)
    assert len(got) == 3 and got[0] == got[1] and got[0][1] and got[2] == (None, "")
    assert find(df.limit(0)).count() == 0


def test_ip_parts_are_judged_whole():
    assert personal_data.patterns("1.2.3.00999 0001.2.3.000255 1.2.3.256 1.2.3.0000") == [("ip", 12, 27), ("ip", 38, 48)]


@pytest.mark.parametrize("factor", [1.0, 1.3])
def test_nearest(spark, factor):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(700, 8)).astype(np.float32)
    m[5] = m[6]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, []), (904, [None] * 8), (100, [float(x) for x in m[100]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in nearest.nearest(df, df.where("vec_id % 100 = 0"), factor=factor).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, round(r.score, 9)))
    share = []
    for q in range(0, 700, 100):
        d = np.sqrt(((m.astype(float) - m[q].astype(float)) ** 2).sum(axis=1))
        want = [(int(i), round(float(d[i]), 9)) for i in np.lexsort((np.arange(700), d)) if i != q][:10]
        share.append(len(set(want) & set(got[q])) / 10)
        assert factor > 1 or got[q] == want
    assert set(got) == set(range(0, 700, 100)) and np.mean(share) >= 0.9
    assert nearest.nearest(df.limit(0), df.limit(0)).count() == 0


def test_toxicity(spark):
    bad = ["idiot", "scum", "trash"]
    rows, labels = [], []
    for i in range(1500):
        w = prose(RNG.randint(5, 40)).split()
        if i % 6 == 0:
            w[RNG.randrange(len(w))] = RNG.choice(bad).upper() + "!!"
        rows.append((i, " ".join(w)))
        if i // 6 % 2 == 0:
            labels.append((i, int(i % 6 == 0)))
    docs_ = spark.createDataFrame([*rows, (5000, None), (5001, "")], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs_.where(~toxicity.held_out()), marks.where(~toxicity.held_out()))
    got = {r.doc_id: r for r in toxicity.score(docs_.where(toxicity.held_out()), model).collect()}
    right = [got[i].predicted == int(i % 6 == 0) for i in got if i < 1500]
    assert np.mean(right) > 0.95 and all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.score(empty(spark), model).count() == 0
    none = toxicity.train(docs_, marks.where("toxic = 0"))
    assert toxicity.score(docs_, none).where("predicted = 1").count() == 0


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(token_counts.tokenizer_path(token_counts.TOKENIZER))
    rows = packing.pack_documents(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), longest=256, round_tokens=2048).collect()
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    texts = dict(ROWS)
    for i, t in texts.items():
        if i is None:
            continue
        ids = np.array([*tool.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()) and bytes(r.ids) == ids[at : at + r.length].tobytes()
            at += r.length
        assert at == len(ids)
    for part in seq.values():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256 and len({r.sequence_length for r in part}) == 1
    assert packing.pack_documents(empty(spark)).count() == 0


def test_substring_dedup(spark, docs):
    count, words = collections.Counter(), []
    for i, t in ROWS:
        w = SPACE.findall(t or "")
        words.append((i, w))
        count.update(tuple(w[a : a + 35]) for a in range(len(w) - 34))
    want = []
    for i, w in words:
        gone = [False] * len(w)
        for a in range(len(w) - 34):
            if count[tuple(w[a : a + 35])] > 1:
                gone[a : a + 35] = [True] * 35
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    assert table(substring_dedup.dedup_substrings(docs), "doc_id", "n_words", "n_removed", "kept") == sorted(want, key=repr)
    assert substring_dedup.dedup_substrings(empty(spark)).count() == 0


def _prints(spark, hashes):
    return spark.createDataFrame([(i, 0, h, h, 0, 1) for i, h in enumerate(hashes)], substring_dedup.PRINTS)


def test_fingerprint_index_compacts(spark):
    index = substring_dedup.FingerprintIndex(spark, max_runs=2)
    for batch in ([1, 2, 2], [3, 1], [4, 4, 5]):
        index.append(_prints(spark, batch))
    assert len(index.live) == 1
    assert sorted(r.h for r in index.prints().collect()) == [1, 1, 2, 2, 3, 4, 4, 5]
    assert sorted(r.h for r in index.repeated().collect()) == [1, 1, 2, 2, 4, 4]
    assert sorted(r.h for r in index.meet(_prints(spark, [5, 6, 6, 7])).collect()) == [5, 5, 6, 6]
    again = substring_dedup.FingerprintIndex(spark, index.path, live=index.live)
    again.append(_prints(spark, [9]))
    assert len(set(again.live)) == 2 and again.prints().count() == 9


def test_substring_dedup_by_batches(spark):
    passage, other = prose(60), prose(45)
    first = [(1, f"{prose(30)} {passage} {prose(9)}"), (2, prose(80)), (3, None)]
    second = [(4, f"{prose(12)} {passage}"), (5, f"{other} x {other}"), (6, prose(90)), (7, ""), (1, first[0][1])]
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = substring_dedup.FingerprintIndex(spark)
    substring_dedup.dedup_batch(make(first), index, make([])).collect()
    got = table(substring_dedup.dedup_batch(make(second), index, make(first)), "doc_id", "n_words", "n_removed")
    words = [SPACE.findall(t or "") for _, t in first + second]
    count = collections.Counter(tuple(w[a : a + 35]) for w in words for a in range(len(w) - 34))
    want = []
    for (i, _), w in zip(second, words[len(first) :], strict=True):
        gone = {x for a in range(len(w) - 34) if count[tuple(w[a : a + 35])] > 1 for x in range(a, a + 35)}
        want.append((i, len(w), len(gone)))
    assert got == sorted(want, key=repr)
    assert len(index.live) == 2


@pytest.mark.parametrize(("size", "num"), [(4, 85), (5, 80)])
def test_jaccard_join(spark, docs, size, num):
    sets = []
    for i, t in ROWS:
        w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
        sets.append((i, {tuple(w[a : a + size]) for a in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()))
    up = list(range(len(sets)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= num * len(x | y):
            up[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    want = sorted(((i, len(s), least.get(root(a))) for a, (i, s) in enumerate(sets) if i is not None), key=repr)
    got = table(jaccard_join.link_documents(docs, shingle=size, num=num).where("doc_id is not null"), "doc_id", "n_shingles", "component_id")
    assert got == want


def test_point_tree_loses_nothing():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, rng.integers(5, 60)).astype(np.uint64)) for _ in range(150)]
    sets += [np.unique(np.concatenate((s[:-1], rng.integers(0, 1 << 63, 1).astype(np.uint64)))) for s in sets[:60]]
    points, n = np.stack([jaccard_join.point(s) for s in sets]), np.array([len(s) for s in sets])
    tree = jaccard_join.PointTree(points, n)
    for i, s in enumerate(sets):
        found = set(tree.search(points[i], len(s), 80, 100))
        for j, t in enumerate(sets):
            both = len(np.intersect1d(s, t))
            assert j in found or 100 * both < 80 * (len(s) + len(t) - both)
            shared = set(jaccard_join.Levels(80, 100).blocks(s)) & set(jaccard_join.Levels(80, 100).blocks(t)) if i < j and 100 * both >= 80 * (len(s) + len(t) - both) else None
            assert shared is None or shared or np.array_equal(s, t)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (20, 21), (30, 29), (29, 28), (28, 27), (5, 5)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 20: 20, 21: 20, 27: 27, 28: 27, 29: 27, 30: 27}


def test_page_text(spark):
    page = '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy</div><article><h1>Ti&amp;tle {0}</h1><p>First\n  part <b>bold</b> {0}.<p>Second &eacute; part.</article><div class="comments"><p>Nice</p></div><aside>x</aside><form><p>f</p></form><footer>&copy;</footer></body></html>'
    rows = [(i, f"http://a.example/{i}", page.replace("{0}", str(i))) for i in range(5)] + [(7, "http://b.example/", None), (8, None, ""), (9, "http://b.example/x", "<p>only text"), (10, "http://b.example/y", "<div>" * 5000 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in page_text.extract_text(df).collect()}
    for i in range(5):
        want = f"Ti&tle {i}\nFirst part bold {i}.\nSecond é part."
        assert got[i] == (want, len(want))
    assert got[7][0] == got[8][0] == "" and got[9][0] == "only text" and got[10][0] == "deep"
    assert page_text.extract_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("attr", ['style="overflow:hidden"', 'aria-hidden="false"', 'title="hidden treasures"', 'class="content has-sidebar"', 'class="no-sidebar"', 'class="post-header"', 'class="entry-header"', 'data-id="menu" data-class="nav"'])
def test_page_text_keeps_main_containers(attr):
    assert page_text.main_text(f"<body><div {attr}><h1>Title</h1><p>Main text</p></div></body>", None) == "Title\nMain text"


@pytest.mark.parametrize("attr", ["hidden", 'hidden=""', "HIDDEN id=x", 'aria-hidden="true"', "aria-hidden=true", 'class="x cookie-banner"', 'class="site-footer"', 'id="main-nav"', 'class="sidebar"', 'id="comments"', 'style="display: none"'])
def test_page_text_drops_noise(attr):
    assert page_text.main_text(f"<body><p>Main text of some length</p><div {attr}>noise</div></body>", None) == "Main text of some length"


def test_page_text_drops_only_boilerplate(spark):
    def words(n):
        return " ".join(f"w{RNG.randrange(10**6)}" for _ in range(n))

    rows, want = [], {}
    for i in range(12):
        h, lead, main, more = words(4), words(15), words(60), words(20)
        bar = '<div class="x1">Same words on each page</div><div class="x2"><a href="/">%s</a></div>' % words(30)
        at = "http://a.example/"
        if i in (3, 8):  # a rarer template
            rows.append((i, at, f'<body class="c{i}">{bar}<section class="z"><h2>{h}</h2><p>{main}</p></section></body>'))
            want[i] = f"{h}\n{main}"
        else:
            rows.append((i, at, f'<body class="c{i}">{bar}<h1>{h}</h1><p class="lead">{lead}</p><div class="body"><p>{main}</p></div><div class="rest">{more}</div></body>'))
            want[i] = f"{h}\n{lead}\n{main}\n{more}"
    for i in range(20, 26):  # the host overrules a name; an advertisement stays out
        main = words(50)
        rows.append((i, "http://b.example/", f'<div class="ad">{words(90)}</div><div class="search"><h1>T{i}</h1><p>{main}</p></div>'))
        want[i] = f"T{i}\n{main}"
    for i in range(30, 38):  # repeated pages do not make boilerplate of the content
        rows.append((i, "http://c.example/", '<div class="t">Foot</div><div class="u"><p>All the same article</p></div>'))
        want[i] = "Foot\nAll the same article"
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r.page_id: r.text for r in page_text.extract_text(df).collect()} == want


def promoted(n=200):
    """Pages of one host with one of six texts before the article, and a rarer template; what each should give."""
    rows, want = [], {}
    for i in range(n):
        body = "".join(f"<p>Sentence {i} {j} of an article that tells something new</p>" for j in range(3 + i % 4))
        rare = f"<h2>Part {i}</h2>" if i % 10 == 0 else ""
        rows.append((i, "http://one.example/x", f"<html><body><div class='x'>Try our offer number {i % 6} today</div><article>{rare}{body}</article></body></html>"))
        want[i] = "\n".join(([f"Part {i}"] if rare else []) + [f"Sentence {i} {j} of an article that tells something new" for j in range(3 + i % 4)])
    return rows, want


@pytest.mark.parametrize("fan_in", [2, 32])
def test_page_text_counts_truly_and_whatever_the_partitions(spark, monkeypatch, fan_in):
    monkeypatch.setattr(page_text, "FAN_IN", fan_in)
    monkeypatch.setattr(page_text, "HELD", 3)
    rows, want = promoted()
    many = [(1000 + i, "http://odd.example/", "<body>" + "".join(f"<{t}>{t} {i}</{t}>" for t in RNG.choices("p h2 h3 ul pre dl".split(), k=6)) + "<div class='ad-x'>ad</div></body>") for i in range(60)]
    df = spark.createDataFrame([(i, u, h, "clash", 1) for i, u, h in [*rows, *many, rows[0], (None, None, rows[1][2])]], "page_id long, url string, html string, host string, part int")
    seen = []
    for parts in (1, 7, 50):
        wrappers = page_text.infer_wrappers(df.repartition(parts))
        seen.append((sorted(map(tuple, wrappers.collect())), sorted((r.page_id is None, r.page_id, r.text) for r in page_text.extract_text(df.repartition(parts)).collect())))
    assert seen[0] == seen[1] == seen[2]
    got = dict((i, t) for _, i, t in seen[0][1])
    assert {i: got[i] for i in want} == want
    # Every page's groups fit its host's expression.
    held = {h: json.loads(w) for h, w in seen[0][0]}
    for _, u, h in [*rows, *many]:
        assert fits(held[u.split("/")[2]], page_text.wrapper_of(page_text.parse(h)))


def fits(w, page):
    """Whether the page's groups can be read off the wrapper in order, by trying all ways."""

    def kids(ws, ps):
        if not ws:
            return not ps
        key, times = ws[0][0], ws[0][1]
        if times in "?*" and kids(ws[1:], ps):
            return True
        if not ps or ps[0][0] != key or not fits(ws[0], ps[0]) or (ps[0][1] in "+*" and times not in "+*"):
            return False
        return kids(ws[1:], ps[1:]) or (times in "+*" and kids([[key, "*", *ws[0][2:]], *ws[1:]], ps[1:]))

    return kids(w[3], page[3])


def test_distinct_counts():
    rng = np.random.default_rng(1)
    for n in (3, 63, 64, 500, 20_000):
        found = page_text.distinct(sorted(rng.integers(0, 2**32, n).tolist())[: page_text.SKETCH])
        assert found == n if n < page_text.SKETCH else abs(found / n - 1) < 0.5


def test_wrapper_alignment():
    a = page_text.wrapper_of(page_text.parse("<ul><li>a<li>b</ul><p>x</p>"))
    b = page_text.wrapper_of(page_text.parse("<ul><li>a</ul><div>y</div><p>x</p>"))
    w = page_text.align(a, b)
    assert [(g[0], g[1]) for g in w[3]] == [("ul", "1"), ("div", "?"), ("p", "1")]
    assert [(g[0], g[1]) for g in w[3][0][3]] == [("li", "+")]


def test_secrets(spark):
    import base64
    import json

    bits = ["token", " ", "=", '"', ":", "AKIA", "ABCDEFGHIJKLMNOP", "deadbeef", "0123", "Password", "API_KEY", "é", ".", "secretſ"]
    for _ in range(2000):
        x = "".join(RNG.choice(bits) for _ in range(RNG.randint(0, 20)))
        want = [("assign", *m.span()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", x, re.I | re.A) if len(m[2]) >= 12]
        want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 18]
        want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 16]
        assert sorted(secrets.patterns(x)) == sorted(want)
    part = lambda d: base64.urlsafe_b64encode(json.dumps(d).encode()).decode().rstrip("=")
    jwt = f"{part({'alg': 'HS256'})}.{part({'sub': 'me'})}.c2ln"
    number = lambda b: bytes([2, len(b)]) + b
    body = number(b"\0") + number(b"\x11" * 60) + number(b"\x01\0\x01")
    der = bytes([0x30, len(body)]) + body
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + base64.b64encode(der).decode() + "\n-----END RSA PRIVATE KEY-----"
    assert [k for k, _, _ in secrets.find(f"x {jwt} y")[1]] == ["jwt"]
    assert [k for k, _, _ in secrets.find(pem)[1]] == ["pem"]
    assert "der" in [k for k, _, _ in secrets.find(der.hex())[1]]
    assert not secrets.find("eyJub3Qganc.dG9r.x " + base64.b64encode(b"M" * 90).decode())[1]
    df = spark.createDataFrame([(1, None), (2, 'a token = "0123456789abcdef0123" b'), (3, "")], "doc_id long, text string")
    assert table(secrets.find_secrets(df), "doc_id", "n_assign", "n_hex") == [(1, 0, 0), (2, 1, 1), (3, 0, 0)]
    assert table(secrets.redact(df), "doc_id", "text") == [(1, None), (2, 'a [secret]" b'), (3, "")]
    assert secrets.find_secrets(empty(spark)).count() == 0


def _der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 + len(b := n.to_bytes((n.bit_length() + 7) // 8, "big"))]) + b
    return bytes([tag]) + size + body


def _field(b):
    return len(b).to_bytes(4, "big") + b


def test_secrets_parse_whole_keys():
    import base64

    enc = lambda b: base64.b64encode(b).decode()
    rsa = _der(0x30, _der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01") + _der(5, b""))
    numbers = _der(0x30, _der(2, b"\0") + b"".join(_der(2, bytes([i + 1]) * 40) for i in range(8)))
    private = _der(0x30, _der(2, b"\0") + rsa + _der(4, numbers))
    scalar = _der(0x30, _der(2, b"\1") + _der(4, b"\7" * 32) + _der(0xA0, _der(6, b"\x2a\x86\x48\xce\x3d\x03\x01\x07")))
    locked = _der(0x30, _der(0x30, _der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x05\x0d") + _der(0x30, b"")) + _der(4, b"\5" * 200))
    kinds = lambda t: [k for k, _, _ in secrets.find(t)[1]]
    for key in (private, scalar, locked, numbers):
        assert kinds(f"key {enc(key)} end") == ["der"] and not kinds(f"key {enc(key[:-1] + b'x' * 3)} end")
        assert kinds("k=" + base64.urlsafe_b64encode(key).decode()) == ["der"]
    public = _der(0x30, rsa + _der(3, b"\0" + numbers))
    assert not kinds(enc(public)) and not kinds("ssh-rsa " + enc(_field(b"ssh-rsa") + _field(b"\1\0\1") + _field(b"\x09" * 64)))
    pub = _field(b"ssh-ed25519") + _field(b"\7" * 32)
    ssh = b"openssh-key-v1\0" + _field(b"none") + _field(b"none") + _field(b"") + (1).to_bytes(4, "big") + _field(pub) + _field(b"\3" * 96)
    assert kinds(enc(ssh)) == ["ssh"] and not kinds(enc(b"openssh-key-v1\0" + b"rubbish" * 20)) and not kinds(enc(ssh[:-5]))
    body = enc(private)
    lines = "\n".join(body[i : i + 64] for i in range(0, len(body), 64))
    for text in (f"-----BEGIN PRIVATE KEY-----\n{lines}\n-----END PRIVATE KEY-----", f"-----BEGIN RSA PRIVATE KEY-----\\n{body}\\n-----END RSA PRIVATE KEY-----"):
        assert kinds(text) == ["pem"]
    # Without armour over lines, and in hex of any case; what follows the key is no part of it.
    for key, kind in ((private, "der"), (locked, "der"), (scalar, "der"), (ssh, "ssh")):
        for width, gap in ((64, "\n"), (76, "\r\n"), (20, "\n  "), (64, "\\n")):
            one = enc(key)
            wrapped = gap.join(one[i : i + width] for i in range(0, len(one), width))
            text = f"see {wrapped}{gap}more text"
            assert [x for x in secrets.find(text)[1]] == [(kind, 4, 4 + len(wrapped))], (kind, width, gap)
            assert not kinds(text.replace(wrapped[30:34], "", 1))
        for large in (key.hex().upper(), key.hex()[:60].upper() + key.hex()[60:], "0x" + key.hex().upper()):
            at = 2 * large.startswith("0x")
            assert ("der", 4 + at, 4 + len(large)) in secrets.find(f"hex {large}.")[1]
            assert not kinds(f"hex {large[:-2]}.")
    headed = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,0011\n\n{enc(bytes(range(160)))}\n-----END RSA PRIVATE KEY-----"
    assert "pem" in kinds(headed)
    assert not kinds("-----BEGIN PRIVATE KEY-----\nnot a key at all\n-----END PRIVATE KEY-----")


def test_step_groups(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(VOCAB) for _ in range(rng.randint(1, 120)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    pieces = spark.createDataFrame(packing.pack_documents(df, longest=256, round_tokens=4096).collect(), packing.SCHEMA)
    groups = {r.sequence_id: r.step_group for r in packing.step_groups(pieces, 1024).collect()}
    length = {r.sequence_id: r.sequence_length for r in pieces.collect()}
    assert set(groups) == set(length)
    held = collections.defaultdict(list)
    for i, g in groups.items():
        held[g].append(length[i])
    for g, sizes in held.items():
        assert len(set(sizes)) == 1 and sum(sizes) <= 1024
    short = collections.Counter(sizes[0] for sizes in held.values() if sum(sizes) < 1024)
    assert max(short.values(), default=0) <= 1
    whole = packing.pack_groups(df, 1024, longest=256, round_tokens=4096).collect()
    assert {(r.sequence_id, r.step_group) for r in whole} == set(groups.items()) and len(whole) == pieces.count()
    assert packing.pack_groups(empty(spark)).count() == 0
    ends = {}
    for r in whole:
        ends[r.sequence_id] = ends.get(r.sequence_id, 0) + r.length
    assert all(length[i] == (n if n & (n - 1) == 0 else 256) for i, n in ends.items())


def test_page_alignment_finds_longest_common_order():
    rng = random.Random(4)

    def longest(x, y):
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                t[i + 1][j + 1] = t[i][j] + 1 if x[i] == y[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(500):
        x, y = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        m = page_text.matches(x, y)
        assert len(m) == longest(x, y) and all(x[i] == y[j] for i, j in m) and all(a < c and b < d for (a, b), (c, d) in zip(m, m[1:], strict=False))
    many = [f"t{i}" for i in range(1500)]
    assert len(page_text.matches(many, many[::2])) == 750


def test_page_regions_do_not_move_pages(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.example/", f'<div class="x{i % 3}">menu</div><article><p>Text {i}</p></article>') for i in range(30)] + [(7, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    sent = table(page_text.extract_text(df), "page_id", "text")
    monkeypatch.setattr(page_text, "SMALL", -1)
    assert table(page_text.extract_text(df), "page_id", "text") == sent and len(sent) == 31


def test_word_hashes_tell_patterned_words_apart():
    from graphloom.llm import wordhash

    thue = lambda n: "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    a = thue(4096)
    b = a.translate(str.maketrans("ab", "ba"))
    h = wordhash.words(f"{a} {b} {a}".encode())
    assert h[0] != h[1] and h[0] == h[2]


@pytest.mark.parametrize("part", [512, 3])
def test_near_copies_that_only_chains_join(spark, monkeypatch, part):
    """Borderline members of one block: links of a chain, a second group, and a null id among them; and in parts."""
    monkeypatch.setattr(jaccard_join, "PART", part)
    words = [f"w{i}" for i in range(60)]
    step = lambda n: " ".join([f"e{i}" for i in range(n)] + words[n:])
    rows = [(100 + n, step(n)) for n in range(0, 24, 3)] + [(None, step(4)), (50, step(1))] + [(200 + i, " ".join(words[:30] + [f"z{i}x{j}" for j in range(30)])) for i in range(20)]
    rng = random.Random(6)
    for i in range(40):  # near copies of which some link and some do not
        w = [f"c{j}" for j in range(80)]
        for j in rng.sample(range(80), rng.randint(0, 4)):
            w[j] = f"k{i}x{j}"
        rows.append((300 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = dict(table(jaccard_join.link_documents(df, shingle=4, num=85).where("doc_id is not null"), "doc_id", "component_id"))
    sets = [(i, set(jaccard_join.shingles(t, 4).tolist())) for i, t in rows]
    up = list(range(len(sets)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if 100 * len(x & y) >= 85 * len(x | y):
            up[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    assert got == {i: least[root(a)] for a, (i, _) in enumerate(sets) if i is not None}

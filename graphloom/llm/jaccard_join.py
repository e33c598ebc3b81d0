"""Similarity join of documents by the Jaccard similarity of their word shingles.

Method. The shingles of a document are hashed into groups by ranges of their hash, and the counts
of the groups make a point. Two sets of a and b shingles overlap in no more than the sum of the
smaller coordinates of their points, so pairs of points, and whole boxes of an R-tree over points,
are passed over when that sum cannot reach the threshold. What is left is verified on the sets.

The trees are small and many. Sets that are similar enough differ in few shingles, so of more
groups than that, one at least holds just the same shingles in both: documents are dealt out by
the content of single groups, and only documents that share one meet in a tree. Copies are one
point with a class id. In each such block all members are first tried against one of them; where
that leaves several components, members outside the largest one are searched against all others.
Trees only mark members that have a candidate, or, where a block has no more candidate pairs than
members, give these pairs, each of which is looked at once for all its blocks. The texts of marked
members meet in one task, where pairs that a bound cannot rule out are verified on whole sets, and
only links that join two components come out: fewer than members, however many pairs a block has.

Defined cases: null or empty texts have no shingles, link with nothing and are their own component;
texts with fewer words than a shingle have the whole sequence as their only one; repeated rows are
copies; rows with null ids link as others do, but give no component its id; rows of one id with
different texts link by their texts alone; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import wordhash, workers
from graphloom.llm.keys import KEY, Scratch, components, keyed

U = np.uint64
#: Coordinates of a point.
DIMS = 128
#: Members of a block that one task holds; larger blocks are dealt out in pairs of parts.
PART = 512
#: Members of a leaf that are compared at once.
LEAF = 32


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of the document's shingles."""
    word = wordhash.words((text or "").encode().lower())
    if not len(word):
        return word
    if len(word) < size:
        return wordhash.runs(word, len(word), seed=len(word))
    return np.unique(wordhash.runs(word, size))


def point(s: np.ndarray) -> np.ndarray:
    return np.bincount((s >> U(64 - int(math.log2(DIMS)))).astype(np.int64), minlength=DIMS).astype(np.int32)


class Levels:
    """Size classes with their number of groups.

    A pair belongs to the class of the size of its smaller set. Sets that reach num/den there
    differ in no more than (den-num)/num of the smaller size.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low, self.groups, self.spare = [1], [], []
        while self.low[-1] < 1 << 40:
            low = self.low[-1]
            high = max(low + 1, int(low * 1.4))
            differ = self.differ(high - 1)
            expected = (differ + 1) * math.exp(-low * num / den / (differ + 1))
            spare = max(1, math.ceil(expected + 2 * math.sqrt(expected))) if differ else 0
            self.groups.append(differ + 1 + spare if differ else 0)
            self.spare.append(spare)
            self.low.append(high)

    def differ(self, smaller: int) -> int:
        return (self.den - self.num) * smaller // self.num

    def of(self, n: int) -> range:
        """Classes in which a set of n may be the smaller or the larger of a pair."""
        first = np.searchsorted(self.low, -(-self.num * n // self.den), side="right") - 1
        return range(int(first), int(np.searchsorted(self.low, n, side="right")))

    def blocks(self, s: np.ndarray) -> np.ndarray:
        """Keys of the groups' contents; classes in which only equal sets can link give none."""
        out, total = [], np.zeros(len(s) + 1, np.uint64)
        np.cumsum(wordhash.mix(s ^ U(0xA5A5A5A5A5A5A5A5)), out=total[1:])
        for level in self.of(len(s)):
            n = self.groups[level]
            if not n:
                continue
            edge = np.searchsorted(s, (np.arange(n + 1, dtype=np.float64) / n * 2.0**64)[1:n].astype(np.uint64))
            edge = np.concatenate(([0], edge, [len(s)]))
            key = wordhash.mix(total[edge[1:]] - total[edge[:-1]] + wordhash.mix(np.arange(n, dtype=np.uint64) + U((level + 1) << 40)))
            full = edge[1:] > edge[:-1]
            # Of the groups with content, enough are left to hold one that no difference touches.
            out.append(key[full] if n - full.sum() <= self.spare[level] else key)
        return np.concatenate(out) if out else np.empty(0, np.uint64)


class PointTree:
    """An R-tree over points: leaves of neighbours in size order, packed into nodes of leaves."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fan: int = 16):
        self.order = np.lexsort((points.argmax(axis=1), sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels, top, low, high = [], self.points, self.sizes, self.sizes
        while True:
            cut = np.arange(0, len(top), fan)
            top, low, high = np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((top, low, high))
            if len(top) <= fan:
                break
        self.fan = fan

    def search(self, p: np.ndarray, n: int, num: int, den: int) -> np.ndarray:
        """Members whose summed smaller coordinates may reach the similarity num/den with (p, n)."""
        at = np.arange(len(self.levels[-1][0]))
        for top, low, high in reversed(self.levels):
            bound = np.minimum(top[at], p).sum(axis=1)
            # Overlap o links if den*o >= num*(n+m-o); the least m of a box asks the least.
            fits = ((num + den) * bound >= num * (n + low[at])) & (den * high[at] >= num * n) & (den * n >= num * low[at])
            at = (at[fits][:, None] * self.fan + np.arange(self.fan)).ravel()
            below = len(self.points) if top is self.levels[0][0] else len(self.levels[self._depth(top) - 1][0])
            at = at[at < below]
        bound = np.minimum(self.points[at], p).sum(axis=1)
        fits = ((num + den) * bound >= num * (n + self.sizes[at])) & (den * self.sizes[at] >= num * n) & (den * n >= num * self.sizes[at])
        return self.order[at[fits]]

    def _depth(self, top: np.ndarray) -> int:
        return next(i for i, x in enumerate(self.levels) if x[0] is top)


def _light(src: DataFrame, size: int) -> DataFrame:
    """One light row for each document: the size and a digest of its set."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (p for b in batches for p in workers.parts(b)):
            sets = [shingles(text, size) for text in b.text]
            n = np.array([len(s) for s in sets], np.int64)
            yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64"), "rk": b.rk, "rk2": b.rk2, "n": n} | {f"d{i + 1}": np.array([_digest(s, i) for s in sets], np.int64) for i in (0, 1)})

    return src.mapInPandas(workers.thrifty(each), "doc_id long, rk long, rk2 int, n long, d1 long, d2 long")


def _digest(s: np.ndarray, seed: int) -> np.int64:
    total = wordhash.mix(s + U(seed * 0x1234567)).sum(dtype=np.uint64) if len(s) else U(seed)
    return wordhash.mix(np.array([total ^ U(len(s))], np.uint64)).view(np.int64)[0]


def _block_rows(src: DataFrame, size: int, levels: Levels) -> DataFrame:
    """Rows (bk, d1); a task gives the rows of each class once, so copies do not heap up."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set[int] = set()
        for b in batches:
            keys, ids, held = [], [], 0
            for text in b.text:
                s = shingles(text, size)
                d1 = int(_digest(s, 0))
                if not len(s) or d1 in done:
                    continue
                if len(done) >= 500_000:  # forgetting only repeats rows
                    done.clear()
                done.add(d1)
                k = levels.blocks(s)
                if len(k):
                    # Six bytes of a key do: what meets by chance is told apart later.
                    keys.append((k >> U(16)).view(np.int64))
                    ids.append(np.full(len(k), d1))
                    held += len(k)
                if held > 500_000:
                    yield pd.DataFrame({"bk": np.concatenate(keys), "d1": np.concatenate(ids)})
                    keys, ids, held = [], [], 0
            if held:
                yield pd.DataFrame({"bk": np.concatenate(keys), "d1": np.concatenate(ids)})

    return src.select("text").mapInPandas(workers.thrifty(each), "bk long, d1 long")


def _shared(rows: DataFrame) -> DataFrame:
    """The rows of blocks with more than one class."""
    here = Window.partitionBy("bk")
    return rows.withColumns({"lo": F.min("d1").over(here), "hi": F.max("d1").over(here)}).where("lo < hi").select("bk", "d1")


def _once(members: DataFrame) -> DataFrame:
    """Rows of blocks; of those with the very same members, by number and sums of hashes, one is left."""
    sign = members.groupBy("bk").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("d1")).alias("x"), F.bit_xor(F.xxhash64("d1", F.lit(1))).alias("y"))
    return members.join(sign.groupBy("m", "x", "y").agg(F.min("bk").alias("bk")).select("bk"), "bk", "left_semi")


def _parts(many: str) -> Column:
    return F.ceil(F.col(many) / PART).cast("int")


def _among(first: Column, count: Column) -> Column:
    """A part of count parts from first on, by the class."""
    return (first + F.pmod(F.hash("d1"), count)).cast("int")


def _to(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(first, last))


def _star_pairs(once: DataFrame) -> DataFrame:
    """Pairs (g, d1) of the least member of each block and every other one."""
    lo = once.groupBy("bk").agg(F.min("d1").alias("lo"))
    return once.join(lo, "bk").where("d1 > lo").select(F.col("lo").alias("g"), "d1").distinct()


def _stars(pairs: DataFrame) -> DataFrame:
    """Task rows (g, p, q, part, d1, comp): the first of pairs (g, d1), as part 0, meets all seconds."""
    centre = pairs.groupBy("g").agg(F.count("*").alias("m")).withColumn("parts", _parts("m"))
    others = pairs.join(centre, "g").withColumn("q", _among(F.lit(1), F.col("parts"))).select("g", F.lit(0).alias("p"), "q", F.col("q").alias("part"), "d1")
    centre = centre.select("g", F.lit(0).alias("p"), _to(F.lit(1), F.col("parts")).alias("q"), F.lit(0).alias("part"), F.col("g").alias("d1"))
    return others.union(centre).withColumn("comp", F.col("d1"))


def _rest(once: DataFrame, comp: DataFrame) -> DataFrame:
    """Task rows of blocks in several components: those outside the largest one meet each other and all of it.

    Least members have met all others and are left out. The largest component of a block takes the first
    parts, which meet no part of their own kind.
    """
    lo = once.groupBy("bk").agg(F.min("d1").alias("lo"))
    rows = once.join(lo, "bk").where("d1 > lo").join(comp, F.col("d1") == F.col("node"), "left").select("bk", "d1", F.coalesce("comp", "d1").alias("comp"))
    sized = rows.groupBy("bk", "comp").agg(F.count("*").alias("n"))
    block = sized.groupBy("bk").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("m")).where("top.n < m")
    block = block.select("bk", F.col("top.comp").alias("most"), F.col("top.n").alias("c"), (F.col("m") - F.col("top.n")).alias("u"))
    rows = _once(rows.select("bk", "d1", "comp").join(block.select("bk"), "bk", "left_semi"))
    block = block.select(F.col("bk").alias("g"), "most", _parts("c").alias("cp"), _parts("u").alias("up"))
    rows = rows.withColumnRenamed("bk", "g").join(block, "g")
    inside = F.col("comp") == F.col("most")
    rows = rows.withColumn("part", F.when(inside, _among(F.lit(0), F.col("cp"))).otherwise(_among(F.col("cp"), F.col("up"))))
    rows = rows.withColumn("other", _to(F.when(inside, F.col("cp")).otherwise(F.lit(0)), F.col("cp") + F.col("up") - 1))
    return rows.select("g", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "d1", "comp")


TASK = ["g", "p", "q"]


def _by_task(rows: DataFrame, work: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray] | None], schema: str) -> DataFrame:
    """work on the columns of each task's rows, which come sorted by task; the last task of a batch waits for the next batch."""
    names = [x.split()[0] for x in schema.split(", ")]

    def done(b: pd.DataFrame, edge: list[int]) -> pd.DataFrame | None:
        cols = {c: b[c].to_numpy() for c in b.columns}
        out = [x for i, j in zip(edge[:-1], edge[1:], strict=True) if (x := work({c: v[i:j] for c, v in cols.items()})) is not None]
        return pd.DataFrame({n: np.concatenate([x[n] for x in out]) for n in names}) if out else None

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            if not len(b):
                continue
            new = np.zeros(len(b), bool)
            for c in TASK:
                x = b[c].to_numpy()
                new[1:] |= x[1:] != x[:-1]
            edge = [0, *np.flatnonzero(new).tolist()]
            held = b.iloc[edge[-1] :]
            if (out := done(b, edge)) is not None:
                yield out
        if held is not None and (out := done(held, [0, len(held)])) is not None:
            yield out

    return rows.repartition(*TASK).sortWithinPartitions(*TASK).mapInPandas(workers.thrifty(each), schema)


def _may_link(bound: np.ndarray, n: np.ndarray | int, m: np.ndarray | int, num: int, den: int) -> np.ndarray:
    """Whether sets of n and m that overlap in no more than the bound may link."""
    return ((num + den) * bound >= num * (n + m)) & (den * np.minimum(n, m) >= num * np.maximum(n, m))


def _marked(rows: DataFrame, points: DataFrame, num: int, den: int, sparse: bool) -> DataFrame:
    """The task rows whose member has another one in its task, of another component, that its R-tree cannot rule out.

    With sparse, tasks that have no more such pairs than members give the pairs (other, d1) instead, as rows of
    part -1, so that a pair which many blocks hold can be told to be one.
    """
    names = [*TASK, "part", "d1", "comp"]

    def work(g: dict[str, np.ndarray]) -> dict[str, np.ndarray] | None:
        vec = np.frombuffer(b"".join(g["vec"]), np.int32).reshape(-1, DIMS)
        n, comp, part, p, q = g["n"], g["comp"], g["part"], g["p"][0], g["q"][0]
        if len(n) <= LEAF:  # a tree of one leaf: its points are compared at once
            fits = (comp[:, None] != comp[None]) & (den * np.minimum(n[:, None], n[None]) >= num * np.maximum(n[:, None], n[None]))
            fits &= (part[:, None] != part[None]) if p != q else True
            i, j = np.nonzero(np.triu(fits))
            fits = (num + den) * np.minimum(vec[i], vec[j]).sum(axis=1) >= num * (n[i] + n[j])
            i, j = i[fits], j[fits]
        else:
            held, asks = (np.flatnonzero(part == p), np.flatnonzero(part == q)) if p != q else (np.arange(len(n)),) * 2
            found = []
            if len(held) and len(asks):
                tree = PointTree(vec[held], n[held])
                for x in asks:
                    near = held[tree.search(vec[x], int(n[x]), num, den)]
                    near = near[(comp[near] != comp[x]) & ((near < x) | (p != q))]
                    found.append((near, np.full(len(near), x)))
            i, j = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
        if not len(i):
            return None
        if sparse and len(i) <= len(n):
            d1 = g["d1"]
            low, high = np.minimum(d1[i], d1[j]), np.maximum(d1[i], d1[j])
            none = np.zeros(len(i), np.int32)
            return {"g": low, "p": none, "q": none, "part": none - 1, "d1": high, "comp": high}
        mark = np.zeros(len(n), bool)
        mark[i] = mark[j] = True
        return {c: g[c][mark] for c in names}

    return _by_task(rows.join(points, "d1").select(*names, "n", "vec"), work, "g long, p int, q int, part int, d1 long, comp long")


def _marked_once(marked: DataFrame) -> DataFrame:
    """Tasks with the very same marked members are verified once, in whichever of them."""
    side = F.xxhash64("d1", F.col("part") == F.col("p"))
    sign = marked.groupBy(*TASK).agg(F.count("*").alias("m"), F.bit_xor(side).alias("x"), F.bit_xor(F.xxhash64(side, F.lit(1))).alias("y"))
    first = sign.groupBy("m", "x", "y").agg(F.min(F.struct(*TASK)).alias("t")).select("t.*")
    return marked.join(first, TASK, "left_semi")


def _gathered(dense: DataFrame, held: Scratch) -> DataFrame:
    """Task rows for the members of dense tasks, which many blocks of one group of copies share.

    Tasks that members connect hold one group. Where it takes fewer rows to bring each part of the whole
    group to each other part once than its tasks have, the group is searched so, else by its tasks.
    """
    node = F.xxhash64(*TASK)
    group = held.stored(components(dense.select(node.alias("a"), F.col("d1").alias("b"))), "group")
    rows = dense.join(group.select(F.col("node").alias("d1"), F.col("comp").alias("s")), "d1")
    sized = rows.groupBy("s").agg(F.count("*").alias("r"))
    members = rows.select("s", "d1", "comp").distinct()
    sized = sized.join(members.groupBy("s").agg(F.count("*").alias("m")), "s").withColumn("parts", _parts("m"))
    whole = sized.where(F.col("m") * F.col("parts") <= F.col("r"))
    spread = members.join(whole.select("s", "parts"), "s").withColumn("part", _among(F.lit(0), F.col("parts")))
    spread = spread.withColumn("other", _to(F.lit(0), F.col("parts") - 1))
    spread = spread.select(F.col("s").alias("g"), F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "d1", "comp")
    return spread.unionByName(rows.join(whole.select("s"), "s", "left_anti").select(spread.columns))


def _links(marked: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that join the components of a task's members, found on whole sets."""

    def work(g: dict[str, np.ndarray]) -> dict[str, np.ndarray] | None:
        sets = [shingles(t, size) for t in g["text"]]
        n, part, d1 = np.array([len(s) for s in sets]), g["part"], g["d1"]
        apart = g["p"][0] != g["q"][0]
        points = np.stack([point(s) for s in sets])
        at = np.concatenate(([0], np.cumsum(n)))
        number = np.unique(np.concatenate(sets), return_inverse=True)[1]
        seen = np.zeros(len(number), bool)
        root = np.unique(g["comp"], return_inverse=True)[1]  # of each member, the component's number so far
        a, b = [], []
        for i in range(1, len(n)):
            open_ = np.flatnonzero(_may_link(np.minimum(points[:i], points[i]).sum(axis=1), n[:i], n[i], num, den) & (root[:i] != root[i]) & (~apart | (part[:i] != part[i])))
            if not len(open_):
                continue
            own = number[at[i] : at[i + 1]]
            seen[own] = True
            for j in open_:
                if root[j] == root[i]:
                    continue
                both = int(np.count_nonzero(seen[number[at[j] : at[j + 1]]]))
                if den * both >= num * (n[i] + n[j] - both):
                    a.append(d1[i])
                    b.append(d1[j])
                    root[root == root[j]] = root[i]
            seen[own] = False
        return {"a": np.array(a, np.int64), "b": np.array(b, np.int64)} if a else None

    return _by_task(marked.join(texts, "d1").select(*TASK, "part", "d1", "comp", "text"), work, "a long, b long")


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100, keep_keys: bool = False) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) of documents linked when den*both >= num*all.

    component_id is the smallest id that links reach, null where they reach null ids only. No pair
    of different texts is lost: block keys, sizes and point bounds only leave out pairs that cannot
    link, and a pair is left unverified only where other links join its members already. keep_keys
    adds comp, which names the component whatever its ids are and is null for texts without
    shingles, and the row key.
    """
    levels = Levels(num, den)
    src = keyed(docs, id_col, text_col)
    held = Scratch(docs.sparkSession)
    light = held.stored(_light(src, shingle), "light")
    classes = light.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("rk", "rk2")).alias("first"))
    once = held.stored(_once(held.stored(_shared(_block_rows(src, shingle, levels)), "blocks").distinct()), "once")
    held.drop("blocks")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (p for b in batches for p in workers.parts(b)):
            sets = [shingles(t, shingle) for t in b.text]
            yield pd.DataFrame({"d1": b.d1, "n": np.array([len(s) for s in sets], np.int64), "vec": [point(s).tobytes() for s in sets], "text": b.text})

    chosen = classes.join(once.select("d1").distinct(), "d1", "left_semi").groupBy("d1").agg(F.min("first").alias("first")).select("d1", "first.rk", "first.rk2")
    met = src.join(chosen, KEY).select("d1", "text").dropDuplicates(["d1"])
    met = held.stored(met.mapInPandas(workers.thrifty(each), "d1 long, n long, vec binary, text string"), "met")
    points, texts = met.select("d1", "n", "vec"), met.select("d1", "text")

    def links(tasks: DataFrame, name: str) -> DataFrame:
        return held.stored(_links(_marked_once(tasks), texts, shingle, num, den), name)

    first = held.stored(_star_pairs(once), "first")
    star = links(held.stored(_marked(_stars(first), points, num, den, False), "marked"), "star")
    comp = held.stored(components(star), "comp")
    marked = held.stored(_marked(_rest(once, comp), points, num, den, True), "marked")
    pairs = marked.where("part < 0").select("g", "d1").distinct().join(first, ["g", "d1"], "left_anti")
    more = links(held.stored(_stars(pairs), "open"), "pairs").union(links(held.stored(_gathered(marked.where("part >= 0"), held), "gathered"), "groups"))
    if not more.isEmpty():
        comp = held.stored(components(star.union(more)), "comp")
    held.drop("once", "met", "first", "marked", "open", "gathered", "group", "star", "pairs", "groups")
    # Ids may be null or stand in rows of different texts, so classes are linked and ids looked up last.
    least = comp.join(classes.select(F.col("d1").alias("node"), "doc_id"), "node").groupBy("comp").agg(F.min("doc_id").alias("least"))
    linked = comp.join(least, "comp").withColumn("linked", F.lit(True))
    whole = classes.join(linked, F.col("d1") == F.col("node"), "left")
    whole = whole.select("d1", "d2", F.coalesce("comp", "d1").alias("comp"), F.when(F.col("linked"), F.col("least")).otherwise(F.col("doc_id")).alias("least"))
    out = light.join(whole, ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component, *(["comp", *KEY] if keep_keys else []))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4, num=85, den=100)

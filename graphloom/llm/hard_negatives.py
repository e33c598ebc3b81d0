"""Hard negatives by inner products on rotated vectors, with early discard.

Vectors are dealt into shards of bounded size by a hash of their id, and every shard turns its vectors
onto their own principal axes. For an anchor and a vector the products of the leading axes are
summed step by step; what is left is at most the product of both residual norms, and a slack takes
in all rounding of rotation and sums. A pair whose bounds leave no window in which it could still
be among the first is discarded after few axes; the survivors are scored by integer products, and
only these scores count. Anchors visit all shards twice: for their positives, among rows of their own
label, and for negatives, inside the score windows that the positives open.

Defined cases: rows without an id, label or vector, or with a null or non-finite component, take no
part, nor do vectors whose scaled squared norm reaches 4e18, as their scores need not fit a long;
rows that repeat an id count once, with the smallest label and then vector; vectors of different
lengths have no score and never meet; all vectors of length 0 score 0; ties go to the smaller id; a
positive of a score below 0 opens no window; anchors without positives, and an empty table, give no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.keys import stored
from graphloom.llm.vectors import finite, scaled, shard_count

#: Candidates judged at once; the first step is short, so that later ones know what to beat.
FIRST, STEP = 512, 4096
#: Anchors judged at once.
BLOCK = 128
FOUND = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"
LOW, HIGH = -(1 << 63), (1 << 63) - 1


class Rotated:
    """Integer vectors of one length by label and id, and the same turned onto their principal axes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        n, d = x.shape
        c = self.x.astype(np.float64)
        self.mean = c.mean(0)
        c -= self.mean
        self.axes = np.linalg.eigh(c.T @ c)[1][:, ::-1] if d else np.empty((0, 0))
        self.turned = c @ self.axes
        #: Axes summed after each step, and what is left of the norm then.
        self.cuts = sorted({max(1, d // 8), max(1, d // 4), max(1, d // 2), d})
        self.rest = [np.sqrt(np.square(self.turned[:, m:]).sum(1)) for m in self.cuts]
        self.size = np.sqrt(np.square(c).sum(1)) + np.sqrt(np.square(self.mean).sum())

    def search(self, anchors: np.ndarray, windows: list[list[tuple[int, int]]], allowed: list[np.ndarray], k: int, skip: np.ndarray) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """For each anchor and window (least and greatest score) the first k ids and scores there.

        allowed: for each anchor, which rows are asked for; skip: the id that each anchor passes over.
        """
        d = self.x.shape[1]
        a = anchors.astype(np.float64)
        base, turned = a @ self.mean, a @ self.axes
        rest = [np.sqrt(np.square(turned[:, m:]).sum(1)) for m in self.cuts]
        # Far above the rounding of d products and of axes that are orthogonal but for rounding.
        slack = 64 * (d + 8) * np.finfo(float).eps * np.sqrt(np.square(a).sum(1))
        wide = max((len(w) for w in windows), default=0)
        least = np.full((len(a), wide), np.inf)
        most = np.full((len(a), wide), -np.inf)
        for i, w in enumerate(windows):
            for j, (lo, hi) in enumerate(w):
                least[i, j], most[i, j] = lo, hi
        best = [[(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in w] for w in windows]
        edges = [0, *range(FIRST, len(self.ids), STEP), len(self.ids)] if len(self.ids) > FIRST else [0, len(self.ids)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            part = slice(lo, hi)
            alive = np.stack([m[part] for m in allowed]) & (self.ids[part][None] != skip[:, None])
            at, sums = np.nonzero(alive), None
            sums = base[at[0]]
            before = 0
            for step, m in enumerate(self.cuts):
                if not len(at[0]):
                    break
                sums = sums + self._products(turned[:, before:m], self.turned[part, before:m], at)
                margin = rest[step][at[0]] * self.rest[step][part][at[1]] + slack[at[0]] * (self.size[part][at[1]] + 1)
                up, down, fit = sums + margin, sums - margin, np.zeros(len(sums), bool)
                for j in range(wide):
                    fit |= (up >= least[at[0], j]) & (down <= most[at[0], j])
                at, sums, before = (at[0][fit], at[1][fit]), sums[fit], m
            self._verified(anchors, windows, best, least, at, lo, k)
        return best

    @staticmethod
    def _products(a: np.ndarray, c: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Inner products of the pairs: all at once where many are left, else pair by pair."""
        if 4 * len(at[0]) > len(a) * len(c):
            return (a @ c.T)[at]
        return np.concatenate([np.einsum("ij,ij->i", a[at[0][i : i + 65536]], c[at[1][i : i + 65536]]) for i in range(0, len(at[0]), 65536)])

    def _verified(self, anchors: np.ndarray, windows: list, best: list, least: np.ndarray, at: tuple[np.ndarray, np.ndarray], lo: int, k: int) -> None:
        """Scores the pairs left by integer products and takes in those that are among the first of a window."""
        rows = at[1] + lo
        parts = [np.einsum("ij,ij->i", anchors[at[0][i : i + 65536]], self.x[rows[i : i + 65536]]) for i in range(0, len(rows), 65536)]
        score = np.concatenate(parts) if parts else np.empty(0, np.int64)
        cut = np.searchsorted(at[0], np.arange(len(anchors) + 1))  # pairs come by anchor
        for i in np.flatnonzero(np.diff(cut)):
            own, ids = score[cut[i] : cut[i + 1]], self.ids[rows[cut[i] : cut[i + 1]]]
            for j, (low, high) in enumerate(windows[i]):
                fit = (own >= low) & (own <= high)
                if not fit.any():
                    continue
                got, s = np.append(best[i][j][0], ids[fit]), np.append(best[i][j][1], own[fit])
                first = np.lexsort((got, ~s))[:k]  # ~s falls as s grows, and never overflows
                best[i][j] = got[first], s[first]
                if len(first) == k:
                    least[i, j] = max(low, int(s[first[-1]]))


def windows_of(scores: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """Least and greatest integer score s with low * p <= 100 * s <= high * p, for each positive's score p."""
    return [(-(-low * int(p) // 100), high * int(p) // 100) for p in scores]


def _rotated(rows: pd.DataFrame) -> dict[int, Rotated]:
    size = rows.x.map(len).to_numpy()
    return {n: Rotated(rows.id.to_numpy()[size == n], rows.label.to_numpy()[size == n].astype(object), np.array(rows.x[size == n].tolist(), np.int64).reshape((size == n).sum(), n)) for n in sorted(set(size))}


def _answers(asked: pd.DataFrame, shards: dict[int, Rotated], k: int, same: bool, low: int, high: int) -> pd.DataFrame:
    out = []
    size = asked.x.map(len).to_numpy()
    for n in sorted(set(size) & set(shards)):
        shard, own = shards[n], asked[size == n]
        x = np.array(own.x.tolist(), np.int64).reshape(len(own), n)
        is_label = {v: shard.labels == v for v in set(own.label)}
        allowed = [is_label[v] if same else ~is_label[v] for v in own.label]
        windows = [[(LOW, HIGH)] if same else windows_of(s, low, high) for s in own.scores]
        for i, found in zip(own.itertuples(), shard.search(x, windows, allowed, k, own.id.to_numpy()), strict=True):
            for j, (ids, score) in enumerate(found):
                of, p = (None, None) if same else (int(i.positives[j]), int(i.scores[j]))
                out += [(i.id, of, p, v, s) for v, s in zip(ids.tolist(), score.tolist(), strict=True)]
    return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score", "vec_id", "score"]).astype({c: "Int64" for c in ("anchor_id", "positive_id", "positive_score", "vec_id", "score")})


def _searched(points: DataFrame, asked: DataFrame, shards: int, k: int, same: bool, low: int = 0, high: int = 0) -> DataFrame:
    """What each shard finds for each anchor. A shard's vectors come before the anchors, which stream past them."""
    no = F.lit(None).cast("array<bigint>")
    points = points.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "id", "label", "x", no.alias("positives"), no.alias("scores"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "id", "label", "x", "positives", "scores")
    rows = points.union(asked).repartition(shards, "shard").sortWithinPartitions("shard", "asks", "label", "id")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, turned = None, [], {}
        for b in batches:
            cut = np.flatnonzero(np.diff(b["shard"].to_numpy(), prepend=-1))
            for i, j in zip(cut, [*cut[1:], len(b)], strict=True):
                part = b.iloc[i:j]
                if part["shard"].iat[0] != at:
                    at, held, turned = part["shard"].iat[0], [], None
                if len(own := part[~part.asks]):
                    held.append(own[["id", "label", "x"]])
                asks = part[part.asks]
                if len(asks) and turned is None:
                    turned, held = _rotated(pd.concat(held)) if held else {}, []
                for first in range(0, len(asks), BLOCK):
                    if len(out := _answers(asks.iloc[first : first + BLOCK], turned, k, same, low, high)):
                        yield out

    return rows.mapInPandas(each, FOUND)


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    is_anchor is a condition on the column id, which holds the rows' ids. Scores are inner products of
    floor(scale * x). For each anchor and each of its first positives, rows of its own label, the first
    negatives of other labels with low * positive score <= 100 * score <= high * positive score.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x * float(scale) ** 2)
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v"))).where(norm < 4e18)
    shards = shard_count(rows, F.size("v"))
    points = rows.select("id", F.struct("label", scaled(F.col("v"), scale).alias("x")).alias("row")).groupBy("id").agg(F.min("row").alias("row")).select("id", "row.*")
    anchors = points.where(is_anchor)
    no = F.lit(None).cast("array<bigint>")
    near = _searched(points, anchors.select("*", no.alias("positives"), no.alias("scores")), shards, positives, True)
    near = _first(near, ["anchor_id"], positives).select(F.col("anchor_id").alias("id"), F.struct("rank", "vec_id", "score").alias("one"))
    # At most the number of positives in a list.
    lists = near.groupBy("id").agg(F.sort_array(F.collect_list("one")).alias("p")).select("id", F.col("p.vec_id").alias("positives"), F.col("p.score").alias("scores"))
    asked = stored(anchors.join(lists, "id"), "anchors")
    found = _searched(points, asked, shards, negatives, False, low, high)
    return _first(found, ["anchor_id", "positive_id"], negatives).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", "embedding", label.alias("label")), F.col("id") % 100 == 0)


OP11_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as x from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as a, c.vec_id as c, a.label = c.label as same, list_sum(list_transform(generate_series(1, len(a.x)), lambda i: a.x[i] * c.x[i]))::bigint as score
  from v a join v c on a.vec_id <> c.vec_id and len(a.x) = len(c.x) where a.vec_id % 100 = 0
), p as (
  select a, c as positive, score as positive_score from (select *, row_number() over (partition by a order by score desc, c) as rn from s where same) where rn <= 5
), n as (
  select p.*, c as negative, score, row_number() over (partition by a, positive order by score desc, c) as rn
  from p join s using (a) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
)
select a as anchor_id, positive as positive_id, rn::int as rank, negative as negative_id, positive_score, score as negative_score from n where rn <= 10
"""

"""Approximate nearest neighbours by vantage-point trees, one for each shard.

Vectors are dealt into shards of bounded size by a hash of their id; every shard builds a tree and
answers every query; the answers of the shards are merged by rank. A subtree is passed over
when the triangle inequality, with its slack multiplied by a factor, puts it beyond the nearest
found so far. Factor 1 is exact; larger factors prune more and may miss some. No vector is copied
but for queries, which meet each shard once; a shard's tree is built once, and queries stream past it.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no
part, nor do rows without an id; vectors of another length than the query are at no distance from
it and not returned; rows that repeat an id count once, with the first vector in order; ties go to
the smaller id; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors in a shard, on average.
SHARD = 8192
LEAF = 256
SCHEMA = "query_id long, vec_id long, score double"


def distances(points: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, each from its own components alone."""
    d = points - q
    return np.sqrt(np.einsum("ij,ij->i", d, d))


class Tree:
    """A vantage-point tree over the rows of a matrix; leaves are scanned."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.nodes: list[tuple] = []
        todo = [(np.arange(len(points)), None, None)]
        while todo:
            rows, parent, side = todo.pop()
            at = len(self.nodes)
            if parent is not None:
                self.nodes[parent][side] = at
            if len(rows) <= LEAF:
                self.nodes.append([rows, None, None, None, None, None, None])
                continue
            pivot = rows[0]  # rows come in the order of a hash
            d = distances(points[rows], points[pivot])
            half = len(rows) // 2
            order = np.argpartition(d, half)
            near, far = order[:half], order[half:]
            # Vantage point, and for both sides the node and the range of distances from it.
            self.nodes.append([pivot, -1, -1, d[near].min(), d[near].max(), d[far].min(), d[far].max()])
            todo += [(rows[near], at, 1), (rows[far], at, 2)]

    def search(self, q: np.ndarray, k: int, factor: float, skip: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of the k nearest, by distance and id."""
        best_d, best_r = np.empty(0), np.empty(0, np.int64)
        reach, todo = math.inf, [(0.0, 0)]
        while todo:
            bound, at = todo.pop()
            # The margin keeps rounding in the bound from losing ties.
            if bound * factor > reach * (1 + 1e-9) and len(best_d) >= k:
                continue
            node = self.nodes[at]
            if node[1] is None:
                rows = node[0]
                d = distances(self.points[rows], q)
                fit = (d <= reach) & ~skip[rows]
                best_d, best_r = np.append(best_d, d[fit]), np.append(best_r, rows[fit])
                if len(best_d) > k:
                    keep = np.lexsort((ids[best_r], best_d))[:k]
                    best_d, best_r = best_d[keep], best_r[keep]
                if len(best_d) >= k:
                    reach = best_d.max()
                continue
            d = float(distances(self.points[node[0]][None], q)[0])
            low = [max(0.0, node[3] - d, d - node[4]), max(0.0, node[5] - d, d - node[6])]
            first = 0 if low[0] <= low[1] else 1
            for side in (1 - first, first):
                todo.append((max(bound, low[side]), node[1 + side]))
        keep = np.lexsort((ids[best_r], best_d))[:k]
        return best_r[keep], best_d[keep]


def _trees(own: pd.DataFrame) -> dict[int, tuple[np.ndarray, Tree]]:
    """A tree for each length of vectors, with the ids of its rows."""
    out, size = {}, own.v.map(len).to_numpy()
    for n in sorted(set(size)):
        ids = own.id.to_numpy()[size == n]
        order = np.argsort((ids * 0x9E3779B1) & 0xFFFFFFFF, kind="stable")
        out[n] = ids[order], Tree(np.stack(own.v.to_numpy()[size == n])[order])
    return out


def _answers(queries: pd.DataFrame, trees: dict, k: int, factor: float) -> pd.DataFrame:
    found = []
    for qid, q in zip(queries.id.tolist(), queries.v, strict=True):
        if len(q) in trees:
            ids, tree = trees[len(q)]
            r, d = tree.search(np.asarray(q), k, factor, ids == qid, ids)
            found.append((np.full(len(r), qid), ids[r], d))
    cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))


def usable(vec: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & ~bad & F.exists(vec, lambda x: x != 0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's k nearest vectors other than its own row."""

    def clean(df: DataFrame) -> DataFrame:
        v = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
        return v.groupBy("id").agg(F.min("v").alias("v"))

    points, asked = clean(vectors), clean(queries)
    shards = max(1, -(-points.count() // SHARD))
    # A shard's vectors come before the queries, which visit every shard; the tree is built once for all of them.
    points = points.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "id", "v")
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "id", "v")
    rows = points.union(asked).repartition(shards, "shard").sortWithinPartitions("shard", "asks")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held, trees = None, [], None
        for b in batches:
            cut = np.flatnonzero(np.diff(b["shard"].to_numpy(), prepend=-1))
            for i, j in zip(cut, [*cut[1:], len(b)], strict=True):
                part = b.iloc[i:j]
                if part["shard"].iat[0] != shard:
                    shard, held, trees = part["shard"].iat[0], [], None
                own = part[~part.asks]
                if len(own):
                    held.append(own[["id", "v"]])
                queries = part[part.asks]
                if len(queries):
                    trees = _trees(pd.concat(held)) if trees is None and held else trees or {}
                    if len(out := _answers(queries, trees, k, factor)):
                        yield out

    found = rows.mapInPandas(each, SCHEMA)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


#: Exact, as the factor is 1. Vectors are stored in single precision and compared in double.
OP4_SQL = """
with v as (
  select vec_id, embedding::double[] as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), d as (
  select q.vec_id as query_id, c.vec_id as vec_id, sqrt(list_sum(list_transform(generate_series(1, len(q.e)), lambda i: (c.e[i] - q.e[i]) * (c.e[i] - q.e[i])))) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 100 = 0
), r as (select *, row_number() over (partition by query_id order by score, vec_id) as rn from d)
select query_id, rn::int as rank, vec_id, score from r where rn <= 10
"""

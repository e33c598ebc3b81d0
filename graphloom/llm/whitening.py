"""Whitening of embeddings by a one-sided Jacobi SVD of a blockwise TSQR.

Entries become integers, whose sums over all vectors are exact. Each task reads its centred rows in
blocks and keeps one triangular factor R; the tasks' factors are stacked and factored again, a fixed
number at a time, until one is left. Plane rotations then make the columns of R orthogonal: their
lengths give the standard deviations, also small ones, to full precision, and the product of the
rotations gives the components. The covariance is never formed for that; it would square the
condition number. How far the whitened rows are from the identity is measured on these rows.

Defined cases: vectors that are null or hold a null or non-finite entry are dropped, and so are vectors
with an entry of 2**52 or more once scaled, whose sums a long need not hold; vectors of different
lengths are fitted and whitened apart, each length with its own n; vectors of length 0 have no
component and no rows; repeated ids and rows count each, null ids stay; a component without variance
(as with one vector, or equal ones) has a null whitened and an explained share of 0, and
identity_error leaves it out; deviation is null where a long cannot hold it; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.keys import stored
from graphloom.llm.vectors import finite, scaled

#: Rows factored at once, as components.
BLOCK = 1 << 19
#: States of tasks that are merged at once.
FAN_IN = 32
#: Lengths are fitted together up to so many numbers in their factors.
TOGETHER = 1 << 22
STATE = "d int, task long, state array<double>"
SCHEMA = "vec_id string, component int, n long, deviation long, whitened double, explained double, identity_error double"


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - S/n in double precision, with no cancellation: the integer part of the mean goes exactly."""
    whole = np.array([s // n for s in total], np.int64)
    return (x - whole) - np.array([(s % n) / n for s in total])


def triangle(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """The factor R of all rows so far, from that of the earlier ones and a block of more."""
    return np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")


def jacobi(r: np.ndarray, most: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors as rows, by one-sided Jacobi rotations.

    All pairs of columns meet once a sweep, in rounds of pairs that share no column.
    """
    d = r.shape[1]
    cols, axes = np.ascontiguousarray(r.T), np.eye(d)
    ring = np.arange(d + d % 2)
    for _ in range(most):
        turned = False
        for _ in range(len(ring) - 1):
            p, q = ring[: len(ring) // 2], ring[: len(ring) // 2 - 1 : -1]
            real = (p < d) & (q < d)
            p, q = p[real], q[real]
            a, b = np.square(cols[p]).sum(1), np.square(cols[q]).sum(1)
            g = np.einsum("ij,ij->i", cols[p], cols[q])
            do = np.abs(g) > 1e-15 * np.sqrt(a * b)
            if do.any():
                turned = True
                p, q, z = p[do], q[do], (b[do] - a[do]) / (2 * g[do])
                t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1, z))
                c = (1 / np.hypot(1, t))[:, None]
                s = c * t[:, None]
                for m in (cols, axes):
                    m[p], m[q] = c * m[p] - s * m[q], s * m[p] + c * m[q]
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if not turned:
            break
    size = np.sqrt(np.square(cols).sum(1))
    order = np.argsort(-size, kind="stable")
    axes = axes[order]
    # One sign for all: the largest entry of each component is positive.
    return size[order], axes * np.where(axes[np.arange(d), np.abs(axes).argmax(1)] < 0, -1.0, 1.0)[:, None]


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray, pd.Series]]:
    """The integer vectors of each length, in blocks, with their ids."""
    for b in batches:
        size = b.x.map(len).to_numpy()
        for d in sorted(set(size)):
            own = b[size == d]
            step = max(1, BLOCK // d)
            for i in range(0, len(own), step):
                part = own.iloc[i : i + step]
                yield int(d), np.array(part.x.tolist(), np.int64).reshape(len(part), d), part.vec_id


def _states(rows: DataFrame, first: Callable, merge: Callable, name: str) -> DataFrame:
    """One state (d, state) a length. first: takes a state or None, and a block; merge: takes two states.

    Each task gives one state for each length; a fixed number of states is merged at a time.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for d, x, _ in _blocks(batches):
            held[d] = first(d, held.get(d), x)
        if held:
            yield pd.DataFrame({"d": list(held), "task": TaskContext.get().partitionId(), "state": [s.ravel() for s in held.values()]})

    def fold(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out = None
        for s in part.sort_values("task").state:
            out = s if out is None else merge(key[0], out, s)
        return pd.DataFrame({"d": [key[0]], "task": [key[1]], "state": [np.ravel(out)]})

    now = stored(rows.mapInPandas(each, STATE), name)
    last = now.agg(F.max("task")).first()[0] or 0
    while last:
        last //= FAN_IN
        now = stored(now.withColumn("up", F.expr(f"task div {FAN_IN}")).groupBy("d", "up").applyInPandas(fold, STATE), name)
    return now.select("d", "state")


def _fitted(rows: DataFrame, sums: dict[int, tuple[int, list[int]]], most: int) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """For each length: components as rows, their standard deviations, 0 if none, and the trace of the covariance."""

    def first(d: int, state: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        return triangle(state, centred(x, *sums[d]))

    def merge(d: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return triangle(np.reshape(a, (-1, d)), np.reshape(b, (-1, d)))

    def solve(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        d = key[0]
        r = np.reshape(part.state.iat[0], (-1, d))
        size, axes = jacobi(r)
        size = np.where(size > size[0] * max(len(r), d) * np.finfo(float).eps, size, 0.0)
        n = sums[d][0]
        k = min(most, d)
        return pd.DataFrame({"d": d, "axis": list(axes[:k]), "deviation": size[:k] / np.sqrt(n), "trace": np.square(size).sum() / n, "nth": range(k)})

    found = _states(rows, first, merge, "triangles").groupBy("d").applyInPandas(solve, "d int, axis array<double>, deviation double, trace double, nth int")
    out: dict[int, list] = {}
    for r in found.orderBy("d", "nth").collect():  # a few components for each length
        out.setdefault(r.d, []).append(r)
    return {d: (np.array([r.axis for r in of]), np.array([r.deviation for r in of]), of[0].trace) for d, of in out.items()}


def whitened(x: np.ndarray, n: int, total: list[int], axes: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    """Rows by components; those without variance are NaN."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(deviation > 0, centred(x, n, total) @ axes.T / deviation, np.nan)


def _errors(rows: DataFrame, sums: dict, models: dict) -> dict[int, float]:
    """Largest entry of the whitened rows' covariance less the identity, for each length.

    A state holds a count, means and sums of centred products, which are merged without losing the centre.
    """

    def first(d: int, state: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        w = np.nan_to_num(whitened(x, *sums[d], *models[d][:2]))
        mean = w.mean(0)
        c = w - mean
        own = np.concatenate([[len(w)], mean, (c.T @ c).ravel()])
        return own if state is None else merge(d, state, own)

    def merge(d: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = len(models[d][1])
        n, step = a[0] + b[0], b[1 : k + 1] - a[1 : k + 1]
        joint = a[k + 1 :] + b[k + 1 :] + np.outer(step, step).ravel() * (a[0] * b[0] / n)
        return np.concatenate([[n], a[1 : k + 1] + step * (b[0] / n), joint])

    out = {}
    for d, state in _states(rows, first, merge, "moments").collect():
        real = models[d][1] > 0
        k = len(real)
        off = np.abs(np.reshape(state[k + 1 :], (k, k)) / state[0] - np.eye(k))[np.ix_(real, real)]
        out[d] = float(off.max(initial=0.0))
    return out


def deviations(x: np.ndarray, n: int, total: list[int]) -> pd.Series:
    """Exact sums over the dimensions of (n * x - S)**2, null beyond a long."""
    about = np.square(n * centred(x, n, total)).sum(1)
    s = np.array([t & (1 << 64) - 1 for t in total], np.uint64).view(np.int64)
    # Wraps around, which leaves sums exact that fit.
    off = x * np.int64(n) - s
    out = pd.Series(np.square(off).sum(1), dtype="Int64")
    for i in np.flatnonzero(about > 9e18):
        exact = sum((n * int(v) - t) ** 2 for v, t in zip(x[i], total, strict=True))
        out[i] = exact if exact < 1 << 63 else pd.NA
    return out


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error), components counted from 1.

    The fit is of x = floor(scale * entry) + shift over all vectors that take part.
    """
    v = F.col("v")
    kind = dict(vectors.dtypes)[id_col]
    # Ids go through as text: pandas would make floats of longs beside a null.
    rows = vectors.select(F.col(id_col).cast("string").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where(finite(v) & (F.size(v) > 0)).where(~F.exists(v, lambda c: F.abs(c) * scale >= float(1 << 52)))
    # try_add, as Spark may evaluate this before the filters, on entries that they take out.
    x = rows.select("vec_id", F.transform(scaled(v, scale), lambda c: F.try_add(c, F.lit(shift).cast("bigint"))).alias("x"))
    lengths = [r[0] for r in x.groupBy(F.size("x").alias("d")).count().orderBy("d").collect()]
    out = None
    while lengths:
        # One length is the rule; more are fitted together as far as their factors stay small.
        now = [lengths.pop(0)]
        while lengths and sum(d * d for d in [*now, lengths[0]]) <= TOGETHER:
            now.append(lengths.pop(0))
        part = _whitened(x.where(F.size("x").isin(now)), components)
        out = part if out is None else out.union(part)
    out = vectors.sparkSession.createDataFrame([], SCHEMA) if out is None else out
    return out.withColumn("vec_id", F.col("vec_id").cast(kind))


def _whitened(x: DataFrame, most: int) -> DataFrame:
    each = x.select(F.size("x").alias("d"), F.posexplode("x").alias("pos", "v")).groupBy("d", "pos").agg(F.sum(F.col("v").cast("decimal(19,0)")).alias("s"), F.count("*").alias("n"))
    sums: dict[int, tuple[int, list[int]]] = {}
    for d, _, s, n in each.orderBy("d", "pos").collect():  # one row a dimension
        sums.setdefault(d, (n, []))[1].append(int(s))
    models = _fitted(x, sums, most)
    errors = _errors(x, sums, models)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d, block, ids in _blocks(batches):
            axes, deviation, trace = models[d]
            k, w, n = len(axes), whitened(block, *sums[d], axes, deviation), sums[d][0]
            share = np.square(deviation) / trace if trace > 0 else np.zeros(k)
            yield pd.DataFrame({
                "vec_id": ids.reset_index(drop=True).repeat(k).reset_index(drop=True), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(w)), "n": n, "deviation": deviations(block, *sums[d]).repeat(k).reset_index(drop=True),
                "whitened": pd.array(w.ravel(), "Float64"), "explained": np.tile(share, len(w)), "identity_error": errors[d],
            })

    return x.mapInPandas(rows, SCHEMA)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

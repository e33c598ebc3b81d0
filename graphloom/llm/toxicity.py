"""Toxicity from confirmed toxic texts and unlabelled ones, by non-negative PU learning.

A linear model over the words of a text and their beginnings is fitted with the class-prior-corrected risk
pi * R+(positive) + max(0, R-(unlabelled) - pi * R-(positive)); where the bracket falls below zero,
the step goes the other way, as the non-negative estimator has it. Confirmed toxic rows are the
positives; all rows of the training part, taken without their labels, are the unlabelled. The prior is
the share of toxic rows among the labelled. Training takes a bounded sample: at most max_positive
positives and max_unlabelled others, those with the smallest hash of their id, so that it is the
same at every run; the words' sets of these alone reach the driver. Scoring goes over all rows.

Where a score of 0.5 stands is found by cross-validation inside the training part: rows left out of
a fit are scored by it, and the cut is that of the largest F with a weight on precision.

Defined cases: null or empty texts get the score of a text without words; no positive label at all
gives every text the prior, 0; repeated rows get equal scores; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import wordhash, workers

BITS = 18


#: Lengths in bytes of the word beginnings that count besides whole words.
HEADS = (4, 5, 6, 7, 8)


def feature_ids(text: str | None, bits: int = BITS) -> np.ndarray:
    """Hashed words and proper beginnings of words, as often as they stand there.

    ASCII case and marks around words don't count; beginnings catch words that are inflected or compounded.
    """
    raw = np.frombuffer((text or "").encode().lower(), np.uint8)
    start, end = wordhash.spans(raw, wordhash.WORDLIKE)
    if not len(start):
        return np.empty(0, np.int32)
    total = wordhash.totals(raw)
    out = [wordhash.span_hashes(total, start, end)]
    for n in HEADS:
        longer = end - start > n
        start, end = start[longer], end[longer]
        out.append(~wordhash.span_hashes(total, start, start + n))
    return (np.concatenate(out) >> np.uint64(64 - bits)).astype(np.int32)


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    bits: int = BITS

    def score(self, text: str | None) -> float:
        ids = feature_ids(text, self.bits)
        z = self.weight[np.unique(ids[self.weight[ids] != 0])].sum(dtype=np.float64) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit_nnpu(rows: list[np.ndarray], positive: np.ndarray, prior: float, bits: int = BITS, epochs: int = 60, rate: float = 0.05, shrink: float = 2e-4, seed: int = 7) -> Model:
    """Minibatch Adam on the non-negative PU risk with the logistic loss."""
    size = 1 << bits
    if not positive.any():
        return Model(np.zeros(size, np.float32), -30.0, bits)
    first: dict = {}
    for i, (r, y) in enumerate(zip(rows, positive, strict=True)):
        first.setdefault((bool(y), _digest(r)), i)
    once = sorted(first.values())  # copies of a text would count as evidence again and again
    rows, positive = [rows[i] for i in once], positive[once]
    keep = _telling(rows, positive, size)
    place = np.where(keep, np.cumsum(keep) - 1, -1)
    rows = [place[r][place[r] >= 0] for r in rows]
    m = int(keep.sum()) + 1  # the last is the bias
    w, mom, sq = np.zeros(m), np.zeros(m), np.zeros(m)
    w[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    rng, step = np.random.default_rng(seed), 0
    pos, unl = np.flatnonzero(positive), np.flatnonzero(~positive)
    parts = max(1, min(64, len(unl) // 64))

    def flat(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        picked = [rows[i] for i in ids]
        return np.concatenate([*picked, np.empty(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(ids)), [len(p) for p in picked])

    def gradient(col: np.ndarray, row: np.ndarray, slope: np.ndarray) -> np.ndarray:
        g = np.bincount(col, slope[row], minlength=m)
        g[-1] = slope.sum()
        return g

    for _ in range(epochs):
        for p, u in zip(np.array_split(rng.permutation(pos), parts), np.array_split(rng.permutation(unl), parts), strict=True):
            if not len(p) or not len(u):
                continue
            (pc, pr), (uc, ur) = flat(p), flat(u)
            zp = np.bincount(pr, w[pc], minlength=len(p)) + w[-1]
            zu = np.bincount(ur, w[uc], minlength=len(u)) + w[-1]
            sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            as_negative = gradient(uc, ur, su / len(u)) - prior * gradient(pc, pr, sp / len(p))
            g = prior * gradient(pc, pr, (sp - 1) / len(p)) + as_negative if negative >= 0 else -as_negative
            step += 1
            mom, sq = 0.9 * mom + 0.1 * g, 0.999 * sq + 0.001 * g * g
            w -= rate * (mom / (1 - 0.9**step)) / (np.sqrt(sq / (1 - 0.999**step)) + 1e-8)
            w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - shrink, 0)
    full = np.zeros(size, np.float32)
    full[np.flatnonzero(keep)] = w[:-1]
    return Model(full, float(w[-1]), bits)


def _digest(row: np.ndarray) -> bytes:
    """Tells word sets apart without a copy of them."""
    return hashlib.blake2b(np.ascontiguousarray(row), digest_size=16).digest()


def _telling(rows: list[np.ndarray], positive: np.ndarray, size: int, least: float = 5.0, rows_with: int = 5) -> np.ndarray:
    """Words whose share of the positives differs from their share of the others by more than chance."""
    n1, n0 = positive.sum(), (~positive).sum()

    def counted(which: np.ndarray) -> np.ndarray:
        """How many of the rows have each word, some rows at a time."""
        out, at = np.zeros(size, np.int64), np.flatnonzero(which)
        for i in range(0, len(at), 256):
            out += np.bincount(np.concatenate([rows[j] for j in at[i : i + 256]]), minlength=size)
        return out

    one, zero = counted(positive), counted(~positive)
    mean = (one + zero) / (n1 + n0)
    error = np.sqrt(np.maximum(mean * (1 - mean), 1e-12) * (1 / n1 + 1 / max(n0, 1)))
    return (np.abs(one / n1 - zero / max(n0, 1)) > least * error) & (one + zero >= rows_with)


def best_cut(z: np.ndarray, toxic: np.ndarray, beta: float = 0.5) -> float:
    """The value from which on rows count as toxic, by the largest F of the given beta; a beta below 1 spares clean rows."""
    order = np.argsort(-z, kind="stable")
    hits, flagged = np.cumsum(toxic[order]), np.arange(1, len(z) + 1)
    last = np.append(z[order][1:] != z[order][:-1], True)  # equal values go together
    f = np.where(last, (1 + beta**2) * hits / (flagged + beta**2 * toxic.sum()), 0)
    at = int(f.argmax())
    return float(z[order][at] + z[order][min(at + 1, len(z) - 1)]) / 2


def fit_with_cut(rows: list[np.ndarray], positive: np.ndarray, label: np.ndarray, prior: float, bits: int = BITS, folds: int = 4, least: int = 20) -> Model:
    """The model fitted on all rows, its bias moved so that a score of 0.5 stands where rows that were left out are told apart best.

    label is 1, 0 or -1 for unknown; clean labels serve for nothing but this cut. With few labels of
    either kind the bias stays.
    """
    model = fit_nnpu(rows, positive, prior, bits)
    known = label >= 0
    if min((label == 1).sum(), (label == 0).sum()) < least:
        return model
    # Copies of a text go to one fold, so that none is told by its own copy.
    fold = np.array([zlib.crc32(np.ascontiguousarray(r)) % folds for r in rows])
    z = np.zeros(len(rows))
    for f in range(folds):
        rest = np.flatnonzero(fold != f)
        part = fit_nnpu([rows[i] for i in rest], positive[rest], prior, bits)
        for i in np.flatnonzero((fold == f) & known):
            z[i] = part.weight[rows[i]].sum(dtype=np.float64) + part.bias
    model.bias -= best_cut(z[known], label[known] == 1)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positive: int = 3000, max_unlabelled: int = 12000, bits: int = BITS) -> Model:
    """Fit on the rows given; hold rows out before calling."""
    known = labels.select(F.col(id_col), F.col(label_col).alias("y")).where("y is not null").groupBy(id_col).agg(F.max("y").alias("y"))
    counts = known.agg(F.count("*").alias("n"), F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("p")).first()
    prior = (counts.p or 0) / max(counts.n, 1)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in workers.parts(b):
                yield pd.DataFrame({"o": p["o"], "y": p["y"], "ids": [np.unique(feature_ids(t, bits)).tobytes() for t in p["text"]]})

    def sample(df: DataFrame, most: int) -> list[tuple[np.ndarray, int]]:
        chosen = df.select(F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.lit(1)).alias("o"), F.col(id_col).alias("i"))
        cut = chosen.select("o").orderBy("o").offset(most).limit(1).collect()
        chosen = chosen.where(F.col("o") < cut[0].o) if cut else chosen
        # At most `most` rows of word sets, made by all tasks at once and fetched in a few parts, then put in the hash's order.
        marked = chosen.join(known.withColumnRenamed(id_col, "i"), "i", "left").select("o", F.coalesce(F.col("y").cast("int"), F.lit(-1)).alias("y"), "text")
        coded = marked.mapInPandas(workers.thrifty(each), "o long, y int, ids binary").repartition(8, "o")
        rows = sorted(((r.o, np.frombuffer(r.ids, np.int32), r.y) for r in coded.toLocalIterator()), key=lambda r: (r[0], _digest(r[1]), r[2]))
        return [(ids, y) for _, ids, y in rows]

    toxic = known.where("y = 1").select(id_col)
    p = sample(docs.join(toxic, id_col, "left_semi"), max_positive)
    u = sample(docs, max_unlabelled)
    positive = np.arange(len(p) + len(u)) < len(p)
    # A confirmed row counts once for the cut, as a positive.
    label = np.array([1] * len(p) + [0 if y == 0 else -1 for _, y in u], np.int64)
    model = fit_with_cut([r for r, _ in p + u], positive, label, prior, bits)
    del p, u
    workers.give_back()
    return model


def score_column(spark: SparkSession, model: Model, text: Column) -> Column:
    """The model's score of a text column, from 0 to 1."""
    shared = spark.sparkContext.broadcast(model)

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return workers.column(each, "double")(text)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of docs with score and predicted, in place of columns of those names."""
    out = docs.withColumn("score", score_column(docs.sparkSession, model, F.col(text_col)))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    model = train(docs.where(~held_out()), labels)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")

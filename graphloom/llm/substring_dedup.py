"""Removal of long repeated passages through a log-structured fingerprint index.

Each document gives the winnowed fingerprints of its words: of every window of consecutive
words at least one, chosen by content alone, so equal windows give equal fingerprints.
The index keeps them, with their places, as immutable runs sorted by fingerprint, one for each batch.
A new batch is merge-joined with the live runs; what occurs twice is verified on whole windows, and
runs are compacted into one when there are many.

Defined cases: null or empty texts have no words and lose none; texts shorter than a window lose
none; repeated rows repeat each other's windows, so both lose them; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import wordhash
from graphloom.llm.keys import KEY, Scratch, delete, keyed, scratch, stored

WINDOW = 35
GRAM = 5
#: Keys of documents, 12 bytes each, that are sent to all tasks at most.
BROADCAST = 2_000_000


def winnow(word: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints by the windows that they stand for: first window, number of windows, hash, hash of the whole stretch.

    A window's fingerprint is the first smallest hash of gram words in it. Windows with the same one
    follow each other, and the stretch is all the words that they cover.
    """
    if len(word) < window:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    h = wordhash.runs(word, gram)
    view = np.lib.stride_tricks.sliding_window_view(h, window - gram + 1)
    at = view.argmin(axis=1) + np.arange(len(view))
    low = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    count = np.diff(np.append(low, len(at)))
    return low, count, h[at[low]], wordhash.stretches(word, low, low + count - 1 + window, seed=5)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


PRINTS = "rk long, rk2 int, h long, c long, low int, windows short"


def fingerprints(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Rows (rk, rk2, h, c, low, windows) of keyed documents."""

    def frame(rows: list) -> pd.DataFrame:
        cols = [np.concatenate(x) for x in zip(*rows, strict=True)]
        return pd.DataFrame(dict(zip(("rk", "rk2", "h", "c", "low", "windows"), cols, strict=True)))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, size = [], 0
            for rk, rk2, text in zip(b.rk.to_numpy(), b.rk2.to_numpy(), b.text, strict=True):
                low, count, h, c = winnow(wordhash.words((text or "").encode()), window, gram)
                if len(low):
                    rows.append((np.full(len(low), rk), np.full(len(low), rk2), _signed(h), _signed(c), low.astype(np.int32), count.astype(np.int16)))
                    size += len(low)
                if size > 300_000:
                    yield frame(rows)
                    rows, size = [], 0
            if size:
                yield frame(rows)

    return docs.select("rk", "rk2", "text").mapInPandas(each, PRINTS)


class FingerprintIndex:
    """Immutable runs of prints, each file of them sorted by fingerprint, below one folder of the shared store.

    The list of live runs is small driver state; a run is never changed once written, and deleted only
    after the run that takes its place is whole. An index can be opened again by its path.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, max_runs: int = 4, live: list[str] | None = None):
        self.spark, self.path, self.max_runs = spark, path or scratch(spark, "fingerprints"), max_runs
        self.live: list[str] = list(live or [])
        self._next = 1 + max([int(x.rpartition("-")[2]) for x in self.live], default=-1)

    def _write(self, prints: DataFrame) -> str:
        run = f"{self.path}/run-{self._next:05d}"
        self._next += 1
        prints.sortWithinPartitions("h").write.parquet(run)
        return run

    def append(self, prints: DataFrame) -> None:
        """Write a batch's prints as one more run; compact where there are many."""
        self.live.append(self._write(prints))
        if len(self.live) > self.max_runs:
            self.compact()

    def prints(self) -> DataFrame:
        """All live runs."""
        reader = self.spark.read.schema(PRINTS)
        return reader.parquet(*self.live) if self.live else self.spark.createDataFrame([], PRINTS)

    def compact(self) -> None:
        """Replace the live runs by one; their files go when it is written."""
        old, self.live = self.live, [self._write(self.prints())]
        for run in old:
            delete(self.spark, run)

    def drop(self) -> None:
        """Delete all runs; the index is empty then."""
        old, self.live = self.live, []
        for run in old:
            delete(self.spark, run)

    def meet(self, prints: DataFrame) -> DataFrame:
        """Prints of a new batch that stand twice in it or in a live run, and the runs' prints that they meet.

        A merge join by fingerprint on both sides; the counts that decide are combined before they move. Without live
        runs the batch meets itself alone, and an empty batch meets nothing.
        """
        fresh = prints.groupBy("h").agg(F.count("*").alias("n"))
        known = self.prints().groupBy("h").agg(F.count("*").alias("m"))
        both = fresh.join(known, "h", "left").where("n > 1 or m is not null").select("h")
        return prints.join(both, "h", "left_semi").unionByName(self.prints().join(both, "h", "left_semi"))

    def repeated(self) -> DataFrame:
        """The prints of all live runs whose fingerprint stands twice in them."""
        twice = self.prints().groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
        return self.prints().join(twice, "h", "left_semi")


def repeated_windows(src: DataFrame, hits: DataFrame, window: int = WINDOW, held: Scratch | None = None) -> DataFrame:
    """Rows (rk, rk2, ranges): ranges (low, windows) of consecutive windows that occur twice.

    hits are all prints of the fingerprints in question, stored, src the texts of all their documents. Where a
    fingerprint repeats, whole stretches are compared first: occurrences with equal stretches repeat each
    other's windows. Only fingerprints with a stretch that stands alone are looked at by single windows,
    in all their occurrences. Counts are combined before they are shuffled and written apart, so that
    the joins by fingerprint are plain ones that Spark splits where one key is hot. held keeps these tables for
    the caller to delete.
    """
    held = held or Scratch(hits.sparkSession)
    stretch = held.stored(hits.groupBy("h", "c").agg(F.count("*").alias("n")), "stretches")
    alone = stretch.groupBy("h").agg(F.min("n").alias("least")).where("least = 1").select("h")
    sure = hits.join(stretch.where("n > 1").select("h", "c"), ["h", "c"], "left_semi").select(*KEY, "low", "windows")
    open_ = held.stored(hits.join(alone, "h", "left_semi").select(*KEY, "low", "windows"), "open")
    open_ = open_.groupBy(*KEY).agg(F.collect_set(F.struct("low", "windows")).alias("at"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, size = [], 0
            for rk, rk2, text, at in zip(b.rk.to_numpy(), b.rk2.to_numpy(), b.text, b["at"], strict=True):
                word = wordhash.words((text or "").encode())
                start = np.sort(np.concatenate([np.arange(x["low"], x["low"] + x["windows"]) for x in at]))
                h = _signed(wordhash.runs(word, window)[start])
                h2 = _signed(wordhash.runs(word, window, seed=77)[start]) >> 32
                rows.append((np.full(len(start), rk), np.full(len(start), rk2), start.astype(np.int32), h, h2.astype(np.int32)))
                size += len(start)
                if size > 300_000:
                    yield _windows(rows)
                    rows, size = [], 0
            if size:
                yield _windows(rows)

    # The same columns of src as in the last join, so that texts are shuffled once for both.
    seen = src.join(open_, KEY).select("doc_id", "text", "rk", "rk2", "at").mapInPandas(each, "rk long, rk2 int, low int, h long, h2 int")
    twice = seen.groupBy("h", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h", "h2")
    single = seen.join(twice, ["h", "h2"], "left_semi").select(*KEY, "low", F.lit(1).cast("short").alias("windows"))
    return sure.union(single).groupBy(*KEY).agg(F.collect_set(F.struct("low", "windows")).alias("ranges"))


def _windows(rows) -> pd.DataFrame:
    cols = [np.concatenate(c) for c in zip(*rows, strict=True)]
    return pd.DataFrame(dict(zip(("rk", "rk2", "low", "h", "h2"), cols, strict=True)))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, batches: int = 3, max_runs: int = 2) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept): every document without its repeated passages.

    A word goes if a window of consecutive words that covers it also starts anywhere else. The input
    goes into an index of its own batch by batch, and is answered from the compacted runs.
    """
    src = keyed(docs, id_col, text_col)
    index = FingerprintIndex(docs.sparkSession, max_runs=max_runs)
    for i in range(batches):
        index.append(fingerprints(src.where(F.pmod("rk", F.lit(batches)) == i), window, gram))
    hits = stored(index.repeated(), "hits")
    index.drop()
    return _without(src, repeated_windows(src, hits, window), window)


def dedup_batch(docs: DataFrame, index: FingerprintIndex, history: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The same rows for a new batch, judged against itself and all documents of the index; the batch then joins the index.

    history has the documents of the index, of which only those that meet the batch go on to have their
    windows verified; their keys are broadcast up to a bound. Rows that the history gave out before are not changed. An
    empty batch gives no rows and adds an empty run; with an empty history and index a batch is judged against itself.
    """
    src, old = keyed(docs, id_col, text_col), keyed(history, id_col, text_col)
    held = Scratch(docs.sparkSession)
    prints = held.stored(fingerprints(src, window, gram), "batch")
    hits = held.stored(index.meet(prints), "hits")
    met = held.stored(hits.select(*KEY).distinct(), "met")
    met = F.broadcast(met) if met.count() <= BROADCAST else met
    marks = stored(repeated_windows(src.union(old.join(met, KEY, "left_semi").select(src.columns)), hits, window, held), "marks")
    index.append(prints)
    held.drop("batch", "hits", "met", "stretches", "open")
    return _without(src, marks, window)


def _without(src: DataFrame, marks: DataFrame, window: int) -> DataFrame:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, text, ranges in zip(b.doc_id, b.text, b.ranges, strict=True):
                word = (text or "").encode().split()
                n = len(word)
                gone = np.zeros(n + 1, np.int32)
                if ranges is not None and len(ranges):
                    low = np.array([x["low"] for x in ranges])
                    np.add.at(gone, low, 1)
                    np.add.at(gone, low + np.array([x["windows"] for x in ranges]) - 1 + window, -1)
                keep = np.cumsum(gone[:n]) == 0
                kept = b" ".join([w for w, k in zip(word, keep, strict=True) if k]) if not keep.all() else b" ".join(word)
                out.append((doc_id, n, int(n - keep.sum()), kept.decode()))
            yield pd.DataFrame({"doc_id": pd.array([x[0] for x in out], dtype="Int64"), "n_words": np.array([x[1] for x in out], np.int64), "n_removed": np.array([x[2] for x in out], np.int64), "kept": [x[3] for x in out]})

    joined = src.join(marks, KEY, "left").select("doc_id", "text", "rk", "rk2", "ranges")
    return joined.mapInPandas(each, "doc_id long, n_words long, n_removed long, kept string")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


__all__ = ["FingerprintIndex", "dedup_batch", "dedup_substrings", "fingerprints", "op7", "repeated_windows", "winnow"]

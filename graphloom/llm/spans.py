"""Spans found in texts, as kind, start and end in code points, and their digests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Span = tuple[str, int, int]


def written(spans: list[Span], kinds: list[str]) -> str:
    """kind:start:end, comma-joined, by start and then by kind as listed."""
    place = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], place.get(x[0], len(place)), x[2])))


def digests(docs: DataFrame, find: Callable[[list[str]], Iterable[tuple[list[Span], list[Span]]]], base: list[str], kinds: list[str], id_col: str, text_col: str) -> DataFrame:
    """One row a document: counts of base kinds, their digest, all spans and the number added.

    find gives base and added spans of each of some whole texts; null counts as empty.
    """
    counts = ", ".join(f"n_{k} long" for k in base)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for old, new in find([text or "" for text in b[text_col]]):
                n = [sum(k == x[0] for x in old) for k in base]
                rows.append((*n, hashlib.sha256(written(old, kinds).encode()).hexdigest(), written(old + new, kinds), len(new)))
            cols = list(zip(*rows, strict=True)) or [[]] * (len(base) + 3)
            out = {"doc_id": b[id_col].astype("Int64")} | {f"n_{k}": np.array(cols[i], np.int64) for i, k in enumerate(base)}
            yield pd.DataFrame(out | {"base_sha256": list(cols[-3]), "spans": list(cols[-2]), "n_added": np.array(cols[-1], np.int64)})

    return docs.select(id_col, text_col).mapInPandas(each, f"doc_id long, {counts}, base_sha256 string, spans string, n_added long")


def apart(spans: list[Span], taken: list[Span]) -> list[Span]:
    """The spans that touch none of those taken, nor an earlier one of their own."""
    out: list[Span] = []
    held = sorted((s, e) for _, s, e in taken)
    starts = [s for s, _ in held]
    reach = np.maximum.accumulate([e for _, e in held]) if held else None
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        i = int(np.searchsorted(starts, e)) if held else 0
        if not (i and reach[i - 1] > s) and not (out and out[-1][2] > s):
            out.append((k, s, e))
    return out

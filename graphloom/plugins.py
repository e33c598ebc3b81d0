"""Detectors and extractors of one's own, registered by name, beside those that rules make.

tagger(text) and extractor(text) give a column of array<string>, classifier(title, content) a column of the struct (kind,
confidence). An extractor may also be a table function, which gets the text and gives rows (phrase), joined laterally. A
detector gets the nodes (id, kind, title, content, tags) and gives edges (source_id, target_id, kind, weight).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T

TAGGERS: dict[str, Callable[[Column], Column]] = {"rules": T.tags}
CLASSIFIERS: dict[str, Callable[[Column, Column], Column]] = {"rules": T.classify_kind}
EXTRACTORS: dict[str, object] = {locale: (lambda text, locale=locale: T.phrases(locale, F.lit(""), text)) for locale in ("en", "ko", "multi")}
DETECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {}
KINDS = {"tagger": TAGGERS, "classifier": CLASSIFIERS, "extractor": EXTRACTORS, "detector": DETECTORS}


def register(kind: str, name: str, function) -> None:
    """Make a function known under a name; the same name again replaces it."""
    KINDS[kind][name] = function


def named(kind: str, name: str):
    if name not in KINDS[kind]:
        raise ValueError(f"no {kind} named {name!r}: {sorted(KINDS[kind])}")
    return KINDS[kind][name]


def tags(text: Column, taggers: list[str]) -> Column:
    """The distinct tags of several taggers, in their order."""
    found = [F.coalesce(named("tagger", t)(text), F.array().cast("array<string>")) for t in taggers]
    return F.array_distinct(F.concat(*found)) if found else F.array().cast("array<string>")


def phrases(docs: DataFrame, extractors: list[str], text_col: str = "text") -> DataFrame:
    """Distinct rows (doc_id, phrase) that any of the extractors finds."""
    out = None
    for name in extractors:
        found = named("extractor", name)
        text = F.coalesce(F.col(text_col), F.lit(""))
        if hasattr(found, "evalType"):  # a table function
            rows = docs.select("doc_id", text.alias("_text"))
            part = rows.lateralJoin(found(F.col("_text").outer())).select("doc_id", "phrase")
        else:
            part = docs.select("doc_id", F.explode(found(text)).alias("phrase"))
        part = part.where("phrase is not null and phrase <> ''")
        out = part if out is None else out.union(part)
    return out.distinct() if out is not None else docs.select("doc_id", F.lit("").alias("phrase")).limit(0)


def detected(nodes: DataFrame, detectors: list[str]) -> DataFrame | None:
    """The edges that all detectors find, those of one pair and kind once, with the largest weight."""
    out = None
    for name in detectors:
        part = named("detector", name)(nodes).select("source_id", "target_id", "kind", F.col("weight").cast("double").alias("weight"))
        out = part if out is None else out.union(part)
    return None if out is None else out.where("source_id <> target_id").groupBy("source_id", "target_id", "kind").agg(F.max("weight").alias("weight"))

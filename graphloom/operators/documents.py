"""Documents as categories, documents and chunks; phrases, hubs, tags and languages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as text_functions
from graphloom.functions.expressions import short_id

EDGE_COLUMNS = ["source_id", "target_id", "kind", "weight"]


BREAK = re.compile(r"(?<=[.!?。\n])\s+")


def split_chunks(text: str, size: int = 1000, overlap: int = 200) -> list[str]:
    """Sentences packed in order while their lengths sum up to size; a chunk begins with the last ones of the one before, to overlap characters."""
    out, now, length = [], [], 0
    for sentence in BREAK.split(text):
        if now and length + len(sentence) > size:
            out.append(" ".join(now))
            kept, length = len(now), 0
            while kept and length + len(now[kept - 1]) <= overlap:
                kept -= 1
                length += len(now[kept])
            now = now[kept:]
        now.append(sentence)
        length += len(sentence)
    return [*out, " ".join(now)]


def chunks(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Rows (doc_id, chunk_index, text): sentences packed into chunks that overlap. Null texts count as empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                cut = [split_chunks(t or "", size, overlap) for t in part.text]
                yield pd.DataFrame({"doc_id": part.doc_id.repeat([len(c) for c in cut]).to_numpy(), "chunk_index": [i for c in cut for i in range(len(c))], "text": [x for c in cut for x in c]})

    return docs.select("doc_id", "text").mapInPandas(each, f"doc_id {kind}, chunk_index int, text string")


def stopword_suggestions(docs: DataFrame, share: float = 0.6, most: int = 30) -> DataFrame:
    """Rows (token, n): words that stand in a share of the texts, the most frequent ones."""
    least = docs.agg(F.greatest(F.lit(2), F.floor(F.count("*") * share)).alias("least"))
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}|[가-힣]{2,}"), F.lit(0)), F.lower))
    counted = docs.select(F.explode(words).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(least), F.col("n") >= F.col("least")).select("token", "n").orderBy(F.col("n").desc(), "token").limit(most)


def document_nodes(docs: DataFrame) -> DataFrame:
    """Category and document nodes; source is the category, the title is the first line, to 80 characters."""
    categories = docs.select(F.col("source").alias("title")).where("title is not null").distinct().select(short_id("cat_", F.col("title")).alias("id"), F.lit("concept").alias("kind"), "title")
    title = F.substring(F.substring_index(F.col("text"), "\n", 1), 1, 80)
    return categories.union(docs.select(short_id("doc_", F.col("doc_id")).alias("id"), F.lit("entity").alias("kind"), title.alias("title")))


def part_of_edges(docs: DataFrame) -> DataFrame:
    return docs.where("source is not null").select(short_id("doc_", F.col("doc_id")).alias("source_id"), short_id("cat_", F.col("source")).alias("target_id"), F.lit("part_of").alias("kind"), F.lit(1.0).alias("weight"))


def chunk_id(doc: Column, index: Column) -> Column:
    return short_id("chunk_", doc, index)


def chunk_edges(parts: DataFrame) -> DataFrame:
    """CONTAINS from documents to chunks, NEXT_CHUNK between neighbours of a document."""
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    here = chunk_id(F.col("doc_id"), F.col("chunk_index"))
    holds = parts.select(short_id("doc_", F.col("doc_id")).alias("source_id"), here.alias("target_id"), F.lit("contains").alias("kind"), F.lit(1.0).alias("weight"))
    following = parts.select("doc_id", here.alias("source_id"), F.lead("chunk_index").over(order).alias("n")).where("n is not null")
    return holds.union(following.select("source_id", chunk_id(F.col("doc_id"), F.col("n")).alias("target_id"), F.lit("next_chunk").alias("kind"), F.lit(1.0).alias("weight")))


def categories(docs: DataFrame) -> DataFrame:
    return docs.where("source is not null").groupBy(F.col("source").alias("category")).agg(F.count("*").alias("documents"))


def phrases(docs: DataFrame, pattern: str = r"[A-Z][a-z]{4,}") -> DataFrame:
    """Distinct (doc_id, phrase), lower case."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda p: F.lower(p)))
    return docs.select("doc_id", F.explode(found).alias("phrase"))


def phrase_df(found: DataFrame) -> DataFrame:
    return found.groupBy("phrase").agg(F.count_distinct("doc_id").alias("df"))


def entity_links(found: DataFrame, documents: int, least: int = 3, share: float = 0.3, per_source: int = 15) -> DataFrame:
    """MENTIONS edges from documents to hubs of phrases in least to share of the documents.

    A source keeps its longest phrases first, then in alphabetical order.
    """
    hubs = phrase_df(found).where(F.col("df").between(least, max(1, int(share * documents))))
    order = Window.partitionBy("doc_id").orderBy(F.length("phrase").desc(), "phrase")
    kept = found.join(hubs, "phrase").withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_source)
    return kept.select(short_id("doc_", F.col("doc_id")).alias("source_id"), short_id("phrase_", F.col("phrase")).alias("target_id"), F.lit("mentions").alias("kind"), F.lit(0.8).alias("weight"))


def tags(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, tag) of the words that a text holds."""
    return docs.select("doc_id", F.explode(text_functions.tags(F.col("text"))).alias("tag"))


def locale_mix(docs: DataFrame, any_letter: bool = False) -> DataFrame:
    """Documents by script: latin, hangul, kana or multi, by a half of the letters.

    any_letter: by the scripts that they hold a letter of, so that a text of two scripts counts for both and one without letters for none.
    """
    scripts = {"latin": "A-Za-z", "hangul": "가-힣", "kana": "ぁ-ヿ"}
    held = docs.where("text is not null")
    if any_letter:
        kinds = F.array_compact(F.array(*[F.when(F.col("text").rlike(f"[{cls}]"), F.lit(name)) for name, cls in scripts.items()]))
        return held.select(F.explode(kinds).alias("locale")).groupBy("locale").agg(F.count("*").alias("n"))
    count = lambda cls: F.length("text") - F.length(F.regexp_replace("text", f"[{cls}]+", ""))
    counts = held.select(*[count(cls).alias(name) for name, cls in scripts.items()])
    letters = F.col("latin") + F.col("hangul") + F.col("kana")
    kind = F.when(letters == 0, "multi")
    for name in scripts:
        kind = kind.when(F.col(name) * 2 >= letters, name)
    return counts.groupBy(kind.otherwise("multi").alias("locale")).agg(F.count("*").alias("n"))


def turn_chain(turns: DataFrame) -> DataFrame:
    """FOLLOWED_BY edges between the turns of a conversation."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    name = lambda c, t: F.concat_ws(":", c.cast("string"), t.cast("string"))
    nxt = turns.select("conv_id", "turn", F.lead("turn").over(order).alias("n")).where("n is not null")
    return nxt.select(name(F.col("conv_id"), F.col("turn")).alias("source_id"), name(F.col("conv_id"), F.col("n")).alias("target_id"), F.lit("followed_by").alias("kind"))

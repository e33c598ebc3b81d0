"""A folder of files of many kinds as one graph.

Each kind is read by what is registered for its suffix: CSV and JSON lines by Spark's own readers, which split large
files; all others as whole files by a parser, in tasks. Files whose names begin with a dot or an underscore are skipped.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.expressions import short_id
from graphloom.operators.ingest import Table, add_documents, ingest_tables
from graphloom.schema import DOCUMENT

#: Turns a file's bytes and path into records (title, text); a title of None takes the file's name.
Parser = Callable[[bytes, str], Iterable[tuple[str | None, str]]]
TABLES, LINES = ("csv",), ("jsonl", "ndjson", "json")
HIDDEN_PARTS = re.compile(r"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>")
BREAKS = re.compile(r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|title|body)\b[^>]*>")


def plain_text(data: bytes, path: str) -> Iterator[tuple[str | None, str]]:
    yield None, data.decode("utf-8-sig", "replace")


def markdown(data: bytes, path: str) -> Iterator[tuple[str | None, str]]:
    """The first heading is the title."""
    text = data.decode("utf-8-sig", "replace")
    head = re.search(r"(?m)^#{1,6}[ \t]+(.+?)[ \t#]*$", text)
    yield head[1] if head else None, text


def web_page(data: bytes, path: str) -> Iterator[tuple[str | None, str]]:
    """The page's title and its text without tags, scripts and styles."""
    page = HIDDEN_PARTS.sub(" ", data.decode("utf-8-sig", "replace"))
    title = re.search(r"(?is)<title[^>]*>(.*?)</title>", page)
    body = BREAKS.sub("\n", page[title.end() :] if title else page)
    lines = (" ".join(html.unescape(x).split()) for x in re.sub(r"<[^>]*>", "", body).split("\n"))
    yield " ".join(html.unescape(title[1]).split()) if title else None, "\n".join(x for x in lines if x)


PARSERS: dict[str, Parser] = {"txt": plain_text, "text": plain_text, "md": markdown, "markdown": markdown, "html": web_page, "htm": web_page}


def register_parser(suffix: str, parser: Parser) -> None:
    """Read files of a suffix by this parser from now on."""
    PARSERS[suffix.lower().lstrip(".")] = parser


@dataclass(frozen=True)
class Folder:
    """A folder's nodes and edges, and rows (kind, files, records, bad): what was read of each kind, and what could not be."""

    nodes: DataFrame
    edges: DataFrame
    report: DataFrame


def files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, kind, size, content) of the files below a folder, or that a pattern names; contents are read when they are asked for."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select("path", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("kind"), F.col("length").alias("size"), "content")


def parsed(found: DataFrame) -> DataFrame:
    """Rows (doc_id, title, text, category, error) of whole files (path, kind, content): one that its parser refuses has an error."""
    parsers = dict(PARSERS)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, kind, content in zip(b.path, b.kind, b.content, strict=True):
                name, folder = path.rsplit("/", 1)[-1], path.rsplit("/", 2)[-2]
                try:
                    records = list(parsers[kind](content, path))
                    rows += [(path if len(records) == 1 else f"{path}#{i}", title or name, text, folder, None) for i, (title, text) in enumerate(records)]
                except Exception as e:  # noqa: BLE001  reported, so that other files go on
                    rows.append((path, name, None, folder, str(e)[:300]))
            yield pd.DataFrame(rows, columns=["doc_id", "title", "text", "category", "error"])

    return found.select("path", "kind", "content").mapInPandas(each, "doc_id string, title string, text string, category string, error string")


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Documents of JSON lines; bad is the line where it holds none."""
    schema = f"{DOCUMENT}, bad string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").json(paths)
    whole = F.coalesce(F.nullif("content", F.lit("")), F.array_join(F.transform(F.array_sort("chunks", lambda a, b: F.coalesce(a["index"], F.lit(0)) - F.coalesce(b["index"], F.lit(0))), lambda c: c["text"]), "\n"))
    # A line without an id is as bad as one that is no JSON.
    bad = F.coalesce("bad", F.when(F.col("doc_id").isNull(), F.to_json(F.struct("title", "content"))))
    return rows.select("doc_id", F.coalesce("title", "doc_id").alias("title"), F.coalesce(whole, F.lit("")).alias("text"), "category", bad.alias("bad"))


def read(spark: SparkSession, path: str) -> Folder:
    """The graph of all files whose suffix something is registered for; others are in the report alone.

    Each CSV name is a table, its first column the key; documents of all other kinds are cut into chunks, and are part of
    their category, which is that of the record, else the folder that the file lies in.
    """
    found = files(spark, path)
    kinds = {r.kind: r.n for r in found.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    nodes, edges, told = [], [], []
    if any(k in kinds for k in TABLES):
        names: dict[str, list[str]] = {}
        for r in found.where(F.col("kind").isin(*TABLES)).select("path").orderBy("path").collect():  # one row a table file
            names.setdefault(r.path.rsplit("/", 1)[-1].rsplit(".", 1)[0], []).append(r.path)
        made = [Table(n, spark.read.csv(p, header=True, inferSchema=False), None) for n, p in names.items()]
        for t in made:
            t.key = t.rows.columns[0]
        n, e = ingest_tables(made)
        nodes.append(n)
        edges.append(e)
        told += [t.rows.agg(F.lit("csv").alias("kind"), F.count("*").alias("records"), F.lit(0).cast("long").alias("bad")) for t in made]
    docs = None
    if held := [k for k in LINES if k in kinds]:
        own = lines(spark, [r.path for r in found.where(F.col("kind").isin(held)).select("path").collect()])
        docs = own.where("bad is null").select("doc_id", "title", "text", "category")
        told.append(own.agg(F.lit("jsonl").alias("kind"), F.count(F.when(F.col("bad").isNull(), 1)).alias("records"), F.count("bad").alias("bad")))
    if held := [k for k in PARSERS if k in kinds]:
        own = parsed(found.where(F.col("kind").isin(held)))
        rest = own.where("error is null").select("doc_id", "title", F.coalesce("text", F.lit("")).alias("text"), "category")
        docs = rest if docs is None else docs.union(rest)
        suffix = F.lower(F.regexp_extract("doc_id", r"\.([A-Za-z0-9]+)(?:#[0-9]+)?$", 1))
        told.append(own.groupBy(suffix.alias("kind")).agg(F.count(F.when(F.col("error").isNull(), 1)).alias("records"), F.count("error").alias("bad")))
    if docs is not None:
        n, e = add_documents(docs)
        from graphloom.operators import documents

        first = documents.chunk_id(F.col("doc_id"), F.lit(0))
        named = docs.where("category is not null and category <> ''").select(first.alias("source_id"), short_id("cat_", F.col("category")).alias("target_id"), "category")
        whole = lambda df: df.select("id", "kind", "title", "content", F.array().cast("array<string>").alias("tags"), F.create_map().cast("map<string,string>").alias("properties"))
        nodes += [whole(n), whole(named.select(F.col("target_id").alias("id"), F.lit("concept").alias("kind"), F.col("category").alias("title"), F.lit("").alias("content")).distinct())]
        edges += [e, named.select("source_id", "target_id", F.lit("part_of").alias("kind"), F.lit(0.7).alias("weight"))]
    if not nodes:
        raise ValueError(f"no data files at {path!r}")
    counted = spark.createDataFrame([("jsonl" if k in LINES else k, n) for k, n in kinds.items()], "kind string, files long").groupBy("kind").agg(F.sum("files").alias("files"))
    read_ = told[0]
    for t in told[1:]:
        read_ = read_.union(t)
    report = counted.join(read_.groupBy("kind").agg(F.sum("records").alias("records"), F.sum("bad").alias("bad")), "kind", "left")
    both = lambda parts: parts[0] if len(parts) == 1 else parts[0].union(both(parts[1:]))
    return Folder(both(nodes), both(edges), report.select("kind", "files", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("bad", F.lit(0)).alias("bad")))

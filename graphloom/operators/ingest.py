"""Rows of tables, documents and plain records as nodes and edges, with ids derived from keys."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, IntegralType

from graphloom import plugins
from graphloom.functions import text as T
from graphloom.functions.expressions import short_id
from graphloom.operators import documents, graph

#: Parts of column names by how much their columns say, the most telling first.
TELLING = [
    "name title label nm 이름 제목 상품명 goods_nm product_name",
    "description desc detail content 설명 상세 goods_detail product_desc",
    "category type kind class group 종류 분류 category_name group_name",
    "tag tags season attribute 속성 태그",
]
#: Columns that give a row its title, the first that is there.
TITLES = ("name", "title", "label", "이름", "제목")
NODE_COLUMNS = ["id", "kind", "title", "content", "tags", "properties"]


@dataclass
class Table:
    """A table's rows with its key and its foreign keys, column to (table, key column).

    read, where a source offers it, reads some columns (None: all) of the rows that meet conditions (column, sign, value).
    """

    name: str
    rows: DataFrame
    key: str | None
    foreign: dict[str, tuple[str, str]] = field(default_factory=dict)
    read: Callable[[list[str] | None, list[tuple]], DataFrame] | None = None

    @property
    def bridge(self) -> bool:
        """Two foreign keys or more, and one other column at most: no nodes, but edges."""
        other = [c for c in self.rows.columns if c not in self.foreign and c != self.key]
        return len(self.foreign) >= 2 and len(other) <= 1


def column_priority(name: str) -> int:
    low = name.lower()
    return next((i for i, parts in enumerate(TELLING) if any(p in low for p in parts.split())), len(TELLING))


def canonical(value: Column, kind: DataType) -> Column:
    """A key as text that does not depend on how it was read: whole numbers without a fraction, null as nothing."""
    text = value.cast("string")
    if not isinstance(kind, IntegralType):
        whole = isinstance(kind, (DoubleType, FloatType)) or kind.typeName() == "decimal"
        if whole:
            text = F.when(value == F.floor(value), F.floor(value).cast("decimal(38,0)").cast("string")).otherwise(text)
    return F.coalesce(text, F.lit(""))


def cast_row(df: DataFrame, types: dict[str, str]) -> Column:
    """A map of a row's values by column, as text: whole numbers, numbers and truth values in plain form where they are one; no nulls."""
    casts = {"int": "bigint", "float": "double", "bool": "boolean"}
    pairs = []
    for c in df.columns:
        text = F.col(c).cast("string")
        typed = text.try_cast(casts[types[c]]).cast("string") if types.get(c) in casts else text
        pairs.append(F.struct(F.lit(c).alias("key"), F.coalesce(typed, text).alias("value")))
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def row_content(df: DataFrame, table: str, hints: dict[str, int] | None = None) -> Column:
    """table: v1 | v2 ..., the telling columns first; hints say the place of a column."""
    named = [c for c in df.columns if not c.startswith("_")]
    ordered = sorted(named, key=lambda c: (hints or {}).get(c, column_priority(c)))
    return graph.row_text(table, [F.trim(F.col(c).cast("string")) for c in ordered])


def row_title(df: DataFrame, table: str, key: str) -> Column:
    named = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in TITLES if c in df.columns]
    return F.concat(F.lit(f"{table}:"), F.coalesce(*named, canonical(F.col(key), df.schema[key].dataType)))


def row_key(df: DataFrame, key: str | None) -> Column:
    """The key's canonical text; a table without a key takes a hash of all its columns."""
    if key:
        return canonical(F.col(key), df.schema[key].dataType)
    return F.md5(F.to_json(F.struct(*sorted(df.columns))))


def table_nodes(table: Table) -> DataFrame:
    """One entity for each row, with its values as properties."""
    df = table.rows
    title = row_title(df, table.name, table.key) if table.key else F.concat(F.lit(f"{table.name}:"), row_key(df, None))
    properties = F.map_concat(cast_row(df, {}), F.create_map(F.lit("_table_name"), F.lit(table.name)))
    return df.select(
        F.concat(F.lit(f"{table.name}:"), row_key(df, table.key)).alias("id"), F.lit("entity").alias("kind"), title.alias("title"),
        row_content(df, table.name).alias("content"), F.array(F.lit(table.name)).alias("tags"), properties.alias("properties"),
    )


def table_edges(table: Table, tables: dict[str, Table], keep_dangling: bool = False) -> DataFrame | None:
    """RELATED edges along all foreign keys; a bridge table's edges join the targets of its first two."""
    df, out = table.rows, []
    name = lambda c: F.concat(F.lit(f"{table.foreign[c][0]}:"), canonical(F.col(c), df.schema[c].dataType))
    if table.bridge:
        a, b = list(table.foreign)[:2]
        both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(name(a).alias("source_id"), name(b).alias("target_id")).distinct()
        return both.select("source_id", "target_id", F.lit("related").alias("kind"), F.lit(0.8).alias("weight"))
    for c, (other, other_key) in table.foreign.items():
        rows = df.where(F.col(c).isNotNull())
        if not keep_dangling and other in tables:
            rows = rows.join(tables[other].rows.select(F.col(other_key).cast(df.schema[c].dataType).alias(c)).distinct(), c, "left_semi")
        source = F.concat(F.lit(f"{table.name}:"), row_key(df, table.key))
        out.append(rows.select(source.alias("source_id"), name(c).alias("target_id"), F.lit("related").alias("kind"), F.lit(0.8).alias("weight")))
    merged = None
    for e in out:
        merged = e if merged is None else merged.unionAll(e)
    return merged


def ingest_tables(tables: list[Table], keep_dangling: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a schema; ids are derived, so the order of tables does not matter."""
    by = {t.name: t for t in tables}
    nodes = [table_nodes(t) for t in tables if not t.bridge]
    edges = [e for t in tables if (e := table_edges(t, by, keep_dangling)) is not None]
    spark = tables[0].rows.sparkSession
    first = lambda frames, schema: frames[0] if frames else spark.createDataFrame([], schema)
    all_nodes = first(nodes, "id string, kind string, title string, content string, tags array<string>, properties map<string,string>")
    for n in nodes[1:]:
        all_nodes = all_nodes.unionAll(n)
    all_edges = first(edges, "source_id string, target_id string, kind string, weight double")
    for e in edges[1:]:
        all_edges = all_edges.unionAll(e)
    return all_nodes, all_edges


def add_records(records: DataFrame, classifier: str = "rules", taggers: tuple[str, ...] = ("rules",)) -> DataFrame:
    """Records (title, content) as nodes: composed, classified, tagged, with ids from their content.

    classifier and taggers are names of plugins. A column kind, where records have it, says the kind of a row.
    """
    r = records.select(T.nfc(F.coalesce("title", F.lit(""))).alias("title"), T.nfc(F.coalesce("content", F.lit(""))).alias("content"), *(["kind"] if "kind" in records.columns else []))
    kind = plugins.named("classifier", classifier)(F.col("title"), F.col("content"))["kind"]
    kind = F.coalesce(F.nullif("kind", F.lit("")), kind) if "kind" in records.columns else kind
    text = F.concat_ws("\n", "title", "content")
    return r.select(short_id("node_", F.col("title"), F.col("content")).alias("id"), kind.alias("kind"), "title", "content", plugins.tags(text, list(taggers)).alias("tags"), F.create_map().cast("map<string,string>").alias("properties"))


def add_documents(docs: DataFrame, size: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, title, text): one node where the text is short, else chunks, each after the first a part of it (0.9) and next to its neighbour (0.7)."""
    parts = documents.chunks(docs, size).join(docs.select("doc_id", "title"), "doc_id")
    last = parts.groupBy("doc_id").agg(F.max("chunk_index").alias("last"))
    parts = parts.join(last, "doc_id")
    here = documents.chunk_id(F.col("doc_id"), F.col("chunk_index"))
    title = F.when(F.col("last") > 0, F.concat_ws(" ", "title", F.format_string("(%d/%d)", F.col("chunk_index") + 1, F.col("last") + 1))).otherwise(F.col("title"))
    nodes = parts.select(here.alias("id"), F.when(F.col("last") > 0, "chunk").otherwise("concept").alias("kind"), title.alias("title"), F.col("text").alias("content"))
    later = parts.where("chunk_index > 0")
    edge = lambda to, kind, weight: later.select(here.alias("source_id"), documents.chunk_id(F.col("doc_id"), to).alias("target_id"), F.lit(kind).alias("kind"), F.lit(weight).alias("weight"))
    back = later.select(documents.chunk_id(F.col("doc_id"), F.col("chunk_index") - 1).alias("source_id"), here.alias("target_id"), F.lit("next_chunk").alias("kind"), F.lit(0.7).alias("weight"))
    return nodes, edge(F.lit(0), "part_of", 0.9).unionAll(back)


def merge_documents(old: DataFrame, new: DataFrame, mode: str = "skip", key: str = "doc_id") -> DataFrame:
    """Documents after new ones came in: skip keeps what is known, replace takes the new."""
    if mode not in ("skip", "replace"):
        raise ValueError(f"unknown mode {mode!r}")
    first, second = (old, new) if mode == "skip" else (new, old)
    return first.unionByName(second.join(first.select(key), key, "left_anti").select(first.columns))


def replaced(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without documents and the chunks that they contain."""
    held = edges.where("kind = 'contains'").join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("target_id").alias("id"))
    return graph.delete_nodes(nodes, edges, ids.select("id").union(held))


def profile(docs: DataFrame, samples: int = 1000) -> dict:
    """Language and frequent words of a bounded sample of texts, for the choice of rules; a driver value."""
    some = docs.where("text is not null").orderBy(F.xxhash64("doc_id")).limit(samples)
    locales = some.groupBy(T.detect_locale(F.col("text")).alias("l")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "l").collect()
    return {"locale": locales[0].l if locales else "multi", "stopwords": [r.token for r in documents.stopword_suggestions(some).collect()]}

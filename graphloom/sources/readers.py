"""Files, chunks and databases as DataFrames, and as nodes and edges."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.changes import Store, sync_all
from graphloom.operators.ingest import Table, add_documents, ingest_tables
from graphloom.schema import DOCUMENT

#: By kind of database, the query that lists columns and the one that lists foreign keys.
SCHEMAS = {
    "postgresql": (
        "select c.table_name, c.column_name, c.data_type, k.column_name is not null as is_key from information_schema.columns c left join (select u.table_name, u.column_name from information_schema.table_constraints t join information_schema.key_column_usage u using (constraint_name, table_schema) where t.constraint_type = 'PRIMARY KEY' and table_schema = '{schema}') k on k.table_name = c.table_name and k.column_name = c.column_name where c.table_schema = '{schema}'",
        "select u.table_name, u.column_name, r.table_name as to_table, r.column_name as to_column from information_schema.table_constraints t join information_schema.key_column_usage u on u.constraint_name = t.constraint_name and u.table_schema = t.table_schema join information_schema.constraint_column_usage r on r.constraint_name = t.constraint_name where t.constraint_type = 'FOREIGN KEY' and t.table_schema = '{schema}'",
    ),
    "mysql": (
        "select table_name, column_name, data_type, column_key = 'PRI' as is_key from information_schema.columns where table_schema = '{schema}'",
        "select table_name, column_name, referenced_table_name as to_table, referenced_column_name as to_column from information_schema.key_column_usage where table_schema = '{schema}' and referenced_table_name is not null",
    ),
    "oracle": (
        "select c.table_name, c.column_name, c.data_type, case when k.column_name is null then 0 else 1 end as is_key from all_tab_columns c left join (select o.owner, o.table_name, u.column_name from all_constraints o join all_cons_columns u on u.owner = o.owner and u.constraint_name = o.constraint_name where o.constraint_type = 'P') k on k.owner = c.owner and k.table_name = c.table_name and k.column_name = c.column_name where c.owner = '{schema}'",
        "select o.table_name, u.column_name, r.table_name as to_table, r.column_name as to_column from all_constraints o join all_cons_columns u on u.owner = o.owner and u.constraint_name = o.constraint_name join all_cons_columns r on r.owner = o.r_owner and r.constraint_name = o.r_constraint_name and r.position = u.position where o.constraint_type = 'R' and o.owner = '{schema}'",
    ),
    "sqlserver": (
        "select c.table_name, c.column_name, c.data_type, case when k.column_name is null then 0 else 1 end as is_key from information_schema.columns c left join (select u.table_name, u.column_name from information_schema.table_constraints t join information_schema.key_column_usage u on u.constraint_name = t.constraint_name where t.constraint_type = 'PRIMARY KEY' and t.table_schema = '{schema}') k on k.table_name = c.table_name and k.column_name = c.column_name where c.table_schema = '{schema}'",
        "select f.table_name, f.column_name, p.table_name as to_table, p.column_name as to_column from information_schema.referential_constraints r join information_schema.key_column_usage f on f.constraint_name = r.constraint_name join information_schema.key_column_usage p on p.constraint_name = r.unique_constraint_name and p.ordinal_position = f.ordinal_position where f.table_schema = '{schema}'",
    ),
    "sqlite": (
        "select m.name as table_name, p.name as column_name, p.type as data_type, p.pk > 0 as is_key from sqlite_master m join pragma_table_info(m.name) p where m.type = 'table' and m.name not like 'sqlite_%'",
        "select m.name as table_name, p.\"from\" as column_name, p.\"table\" as to_table, p.\"to\" as to_column from sqlite_master m join pragma_foreign_key_list(m.name) p where m.type = 'table'",
    ),
}
#: The schema that is read where none is named.
DEFAULT_SCHEMA = {"postgresql": "public", "sqlserver": "dbo"}


def csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; the first is the key."""
    return spark.read.csv(path, header=True, inferSchema=False, recursiveFileLookup=True)


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Bad lines are left out."""
    reader = spark.read.option("mode", "DROPMALFORMED").option("recursiveFileLookup", True)
    return (reader.schema(schema) if schema else reader).json(path)


def documents(spark: SparkSession, path: str, chunk_path: str | None = None) -> DataFrame:
    """Documents with their chunks; inline chunks come before those of the chunk file."""
    docs = json_lines(spark, path, DOCUMENT).where("doc_id is not null")
    if not chunk_path:
        return docs
    parts = json_lines(spark, chunk_path, "chunk_id string, doc_id string, text string, index int, page_number int")
    grouped = parts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("index", "chunk_id", "text", "page_number"))).alias("_c"))
    listed = F.transform("_c", lambda c: F.struct(c["chunk_id"].alias("chunk_id"), F.col("doc_id").alias("doc_id"), c["text"].alias("text"), c["index"].alias("index"), c["page_number"].alias("page_number")))
    return docs.join(grouped, "doc_id", "left").withColumn("chunks", F.when(F.size("chunks") > 0, F.col("chunks")).otherwise(listed)).drop("_c")


def texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def database(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table by JDBC, where a driver is on the class path; filters and columns are pushed down."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def dialect(url: str) -> str:
    """The kind of database of a JDBC address."""
    name = re.match(r"jdbc:(\w+):", url)
    kind = {"mariadb": "mysql"}.get(name[1], name[1]) if name else ""
    if kind not in SCHEMAS:
        raise ValueError(f"unknown database address {url!r}")
    return kind


def tables_of(columns: list[tuple], keys: list[tuple], rows) -> list[Table]:
    """Tables from a schema's columns (table, column, type, is_key) and foreign keys (table, column, to_table, to_column); rows gives a table's rows.

    A key of several columns counts as none, so that such rows are told apart by all their columns.
    """
    names = list(dict.fromkeys(c[0] for c in columns))
    out = []
    for name in names:
        own = [c[1] for c in columns if c[0] == name and c[3] and str(c[3]) not in ("0", "false")]
        foreign = {c: (to, to_c) for t, c, to, to_c in keys if t == name}
        out.append(Table(name, rows(name), own[0] if len(own) == 1 else None, foreign))
    return out


def database_tables(spark: SparkSession, url: str, schema: str | None = None, **options: str) -> list[Table]:
    """All tables of a database with their keys; the schema's rows are few and read on the driver."""
    if url.startswith(("sqlite:", "jdbc:sqlite:")):  # needs no driver
        from graphloom.sources import sqlite

        return sqlite.tables(spark, url)
    kind = dialect(url)
    where = schema or DEFAULT_SCHEMA.get(kind, "")
    read = lambda q: [tuple(r) for r in spark.read.format("jdbc").options(url=url, query=q.replace("{schema}", where), **options).load().collect()]
    columns, keys = (read(q) for q in SCHEMAS[kind])
    return tables_of(columns, keys, lambda name: database(spark, url, f"{where}.{name}" if where else name, **options))


def from_database(tables: list[Table], mode: str = "full", store: Store | None = None):
    """Nodes and edges of tables, or with a store what changed since the last run; auto takes the store's way where it knows one of them."""
    if mode not in ("full", "cdc", "auto"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "auto":
        mode = "cdc" if store is not None and any(store.load(t.name).version for t in tables) else "full"
    if mode == "full":
        return ingest_tables(tables)
    if store is None:
        raise ValueError("change capture needs a store")
    return sync_all(tables, store)


def from_chunks(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of chunks made elsewhere: documents that contain them, neighbours in order, and categories.

    Columns: text (or content), and what is there of doc_id, index (or chunk_index), title, category, source and page. A chunk
    without text is left out; one without doc_id is a document of its own; a title that is missing is the first line;
    chunks without a place go by their text. A document takes title and category of its first chunk.
    """
    from graphloom.operators.documents import chunk_edges, chunk_id, short_id

    def of(*names: str) -> Column:
        held = [F.col(n) for n in names if n in chunks.columns]
        return F.nullif(F.trim(held[0].cast("string")), F.lit("")) if held else F.lit(None).cast("string")

    rows = chunks.select(of("doc_id").alias("doc_id"), of("index", "chunk_index").try_cast("int").alias("place"), of("text", "content").alias("text"), *[of(n).alias(n) for n in ("title", "category", "source", "page")]).where("text is not null")
    rows = rows.withColumn("doc_id", F.coalesce("doc_id", F.concat(F.lit("chunk_"), F.substring(F.md5("text"), 1, 12)))).withColumn("title", F.coalesce("title", F.substring(F.substring_index("text", "\n", 1), 1, 80)))
    order = Window.partitionBy("doc_id").orderBy(F.col("place").asc_nulls_last(), "text")
    rows = rows.withColumn("chunk_index", F.coalesce("place", F.row_number().over(order) - 1))
    first = F.struct("chunk_index", "text", "title", "category", "source")
    docs = rows.groupBy("doc_id").agg(F.min(first).alias("f")).select("doc_id", "f.*")
    said = lambda *names: F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))]), lambda k, v: v.isNotNull())
    made = docs.select(short_id("doc_", F.col("doc_id")).alias("id"), F.lit("document").alias("kind"), "title", F.lit("").alias("content"), said("doc_id", "category", "source").alias("properties"))
    parts = rows.select(chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("id"), F.lit("chunk").alias("kind"), "title", F.col("text").alias("content"), said("doc_id", "chunk_index", "category", "source", "page").alias("properties"))
    named = docs.where("category is not null").select(short_id("doc_", F.col("doc_id")).alias("source_id"), short_id("cat_", F.col("category")).alias("target_id"), "category")
    cats = named.groupBy(F.col("target_id").alias("id")).agg(F.min("category").alias("title")).select("id", F.lit("concept").alias("kind"), "title", F.lit("").alias("content"), F.create_map().cast("map<string,string>").alias("properties"))
    part_of = named.select("source_id", "target_id", F.lit("part_of").alias("kind"), F.lit(0.7).alias("weight"))
    return made.union(parts).union(cats), chunk_edges(rows.select("doc_id", "chunk_index", "text")).unionByName(part_of)


def from_data(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a file, of a pattern's or a folder's files of any kinds: tables from CSV, documents from JSON lines, texts and pages."""
    from graphloom.sources import folder

    kind = path.rstrip("/*").rsplit(".", 1)[-1].lower()
    stem = re.split(r"[/\\]", path.rstrip("/*"))[-1].rsplit(".", 1)[0]
    if kind == "csv":
        rows = csv(spark, path)
        return ingest_tables([Table(stem, rows, rows.columns[0])])
    if kind in folder.LINES:
        docs = documents(spark, path).select("doc_id", "title", F.col("content").alias("text"))
    elif kind in ("txt", "md", "text"):
        docs = texts(spark, path).select(F.col("path").alias("doc_id"), F.substring_index("path", "/", -1).alias("title"), "text")
    else:
        whole = folder.read(spark, path)
        return whole.nodes, whole.edges
    return add_documents(docs)

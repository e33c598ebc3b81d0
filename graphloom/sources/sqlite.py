"""Tables of a SQLite file as DataFrames, read in ranges of row numbers, with columns and conditions handed down.

Files are opened read-only where tasks run, so they must lie on a path that all of them have. Conditions are an option of
each read: those that Spark itself would hand down stay with the relation, and a second query of one DataFrame would get
the first one's.
"""

from __future__ import annotations

import json
import re
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from graphloom.operators.ingest import Table
from graphloom.sources.readers import tables_of

FORMAT = "graphloom_sqlite"
#: What a column may hold to be of a type; anything else in it makes the column text.
HOLDS = [("int", LongType(), ("integer", "null")), ("float", DoubleType(), ("real", "integer", "null"))]
SIGNS = ("=", "<", "<=", ">", ">=", "<>")
#: A column, a sign and a value.
Condition = tuple[str, str, object]


def path_of(url: str) -> str:
    """The file of an address such as sqlite:///folder/name.db or of a plain path."""
    return re.sub(r"^(?:jdbc:)?sqlite:(?://(?=/))?", "", url)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def connected(path: str) -> sqlite3.Connection:
    import urllib.parse

    return sqlite3.connect(f"file:{urllib.parse.quote(path)}?mode=ro", uri=True)


def declared(kind: str) -> str:
    """int, float, bool or str by the words of a declared type."""
    low = kind.upper()
    return "int" if "INT" in low else "float" if any(w in low for w in ("REAL", "FLOAT", "DOUBLE", "NUMERIC")) else "bool" if "BOOL" in low else "str"


def table_schema(con: sqlite3.Connection, table: str) -> StructType:
    """The columns by what they are declared as and what they hold: the values of a table decide where the two differ."""
    columns = [(name, declared(kind or "")) for _, name, kind, *_ in con.execute(f"pragma table_info({quoted(table)})")]
    if not columns:
        raise ValueError(f"no table {table!r}")
    tests = []
    for name, kind in columns:
        if kind == "bool":
            tests.append(f"max(typeof({quoted(name)}) <> 'null' and {quoted(name)} not in (0, 1))")
        tests += [f"max(typeof({quoted(name)}) not in {holds})" for _, _, holds in HOLDS]
    found = iter(con.execute(f"select {', '.join(tests)} from {quoted(table)}").fetchone())
    fields = []
    for name, kind in columns:
        is_bool = kind == "bool" and not next(found)
        fit = [t for k, t, _ in HOLDS if not next(found) and (kind == "int" or kind == k)]
        fields.append(StructField(name, BooleanType() if is_bool else fit[0] if fit else StringType()))
    return StructType(fields)


@dataclass
class Rows(InputPartition):
    """Row numbers from first to last, or all rows of a table that has none."""

    first: int | None = None
    last: int | None = None


class Reader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, parts: int, where: list[Condition]):
        self.path, self.table, self.schema, self.parts = path, table, schema, parts
        self.tests = [f"{quoted(c)} {sign} ?" for c, sign, _ in where]
        self.values = [v for *_, v in where]

    def partitions(self) -> list[Rows]:
        con = connected(self.path)
        try:
            first, last = con.execute(f"select min(rowid), max(rowid) from {quoted(self.table)}").fetchone()
        except sqlite3.OperationalError:  # a table without row numbers is read as one
            return [Rows()]
        finally:
            con.close()
        if first is None:
            return [Rows(0, -1)]
        step = -(-(last - first + 1) // self.parts)
        return [Rows(at, min(at + step - 1, last)) for at in range(first, last + 1, step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        tests, values = list(self.tests), list(self.values)
        if partition.first is not None:
            tests, values = ["rowid between ? and ?", *tests], [partition.first, partition.last, *values]
        where = f" where {' and '.join(tests)}" if tests else ""
        plain = {LongType: lambda v: v, DoubleType: float, BooleanType: bool, StringType: lambda v: v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)}
        casts = [plain[type(f.dataType)] for f in self.schema]
        con = connected(self.path)
        try:
            for row in con.execute(f"select {', '.join(quoted(f.name) for f in self.schema)} from {quoted(self.table)}{where}", values):
                yield tuple(None if v is None else cast(v) for cast, v in zip(casts, row, strict=True))
        finally:
            con.close()


class Source(DataSource):
    """Options: path and table; columns and where, both as JSON, and parts where wanted."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        con = connected(self.options["path"])
        try:
            found = table_schema(con, self.options["table"])
        finally:
            con.close()
        names = self.options.get("columns")
        return StructType([found[c] for c in json.loads(names)]) if names else found

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], self.options["table"], schema, int(self.options.get("parts", 8)), [tuple(c) for c in json.loads(self.options.get("where", "[]"))])


def table(spark: SparkSession, url: str, name: str, columns: list[str] | None = None, where: list[Condition] | None = None, parts: int = 8) -> DataFrame:
    """A table's rows that meet all conditions, some columns or all, in so many ranges of row numbers.

    Values are compared as the file compares them: conditions are for columns that hold numbers, or text alone.
    """
    if any(sign not in SIGNS for _, sign, _ in where or []):
        raise ValueError(f"conditions take {SIGNS}")
    spark.dataSource.register(Source)
    reader = spark.read.format(FORMAT).option("path", path_of(url)).option("table", name).option("parts", parts).option("where", json.dumps(where or []))
    return (reader.option("columns", json.dumps(columns)) if columns else reader).load()


def tables(spark: SparkSession, url: str, parts: int = 8) -> list[Table]:
    """All tables with their keys and foreign keys; one that names no column of its target means the target's key."""
    con = connected(path_of(url))
    try:
        names = [r[0] for r in con.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite\\_%' escape '\\' order by name")]
        columns = [(t, name, kind, key) for t in names for _, name, kind, _, _, key in con.execute(f"pragma table_info({quoted(t)})")]
        key = {t: next((c for n, c, _, k in columns if n == t and k == 1), None) for t in names}
        foreign = [(t, r[3], r[2], r[4] or key.get(r[2])) for t in names for r in con.execute(f"pragma foreign_key_list({quoted(t)})")]
    finally:
        con.close()
    out = tables_of(columns, foreign, lambda name: table(spark, url, name, parts=parts))
    for t in out:
        t.read = lambda columns, where, name=t.name: table(spark, url, name, columns, where, parts)
    return out

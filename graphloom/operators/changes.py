"""Change capture: deltas by watermark or row hash, deletions, changed foreign keys, and the state between two runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.ingest import canonical
from graphloom.operators.keyed import Keyed
from graphloom.operators.lineage import written

#: Fixed values, in order of preference: columns that move whenever a row changes. When a row was made does not count.
CHANGE_COLUMNS = ("updated_at", "modified_at", "last_modified", "update_time", "modified_time", "mtime", "last_update", "updatedat", "updated", "modified")


def row_hash(columns: list[str]) -> Column:
    """MD5 over the sorted columns that are not null and not marked by an underscore."""
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in sorted(columns) if not c.startswith("_")]
    return F.md5(F.concat_ws("\x1f", *parts))


def changed_since(source: DataFrame, change_col: str, watermark) -> DataFrame:
    """Rows at or after the watermark; ties are read again. A watermark as text is cast to the column's type."""
    return source.where(F.col(change_col) >= F.lit(watermark).cast(source.schema[change_col].dataType)) if watermark is not None else source


def by_timestamp(source: DataFrame, index: DataFrame, key: str, change_col: str, watermark) -> DataFrame:
    """Rows (key, action) to add or update; index has the keys that are known."""
    known = index.select(F.col(key), F.lit(True).alias("_known")).distinct()
    fresh = changed_since(source, change_col, watermark).join(known, key, "left")
    return fresh.select(key, F.when(F.col("_known"), "update").otherwise("add").alias("action"))


def by_hash(source: DataFrame, index: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows (key, action) that are new or whose hash differs from the index (key, row_hash)."""
    now = source.select(key, row_hash(columns).alias("_now"))
    both = now.join(index.select(key, "row_hash"), key, "left")
    return both.where(F.col("row_hash").isNull() | (F.col("row_hash") != F.col("_now"))).select(key, F.when(F.col("row_hash").isNull(), "add").otherwise("update").alias("action"))


def deleted(source: DataFrame, index: DataFrame, key: str) -> DataFrame:
    return index.select(key).distinct().join(source.select(key), key, "left_anti")


def key_changes(old: DataFrame, new: DataFrame, key: str, fk: str) -> DataFrame:
    """Rows (key, old_target, new_target) whose foreign key differs."""
    both = old.select(key, F.col(fk).alias("old_target")).join(new.select(key, F.col(fk).alias("new_target")), key, "full_outer")
    return both.where(~F.col("old_target").eqNullSafe(F.col("new_target")))


def merge(current: DataFrame, delta: DataFrame, key: str, gone: DataFrame | None = None) -> DataFrame:
    """The table after a delta of whole rows and deletions."""
    kept = current.join(delta.select(key), key, "left_anti").unionByName(delta.select(current.columns))
    return kept if gone is None else kept.join(gone.select(key), key, "left_anti")


def fingerprint(df: DataFrame) -> str:
    return ",".join(sorted(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema))


def change_column(df: DataFrame) -> str | None:
    """The column that tells when a row changed: a well-known name, else the first that contains one."""
    low = {c.lower(): c for c in df.columns}
    return next((low[n] for n in CHANGE_COLUMNS if n in low), None) or next((c for n in CHANGE_COLUMNS for k, c in low.items() if n in k), None)


def key_index(df: DataFrame, key: str, foreign: list[str] | None = None) -> DataFrame:
    """Rows (pk, row_hash, keys): what one run leaves for the next one; keys are the foreign keys' values."""
    text = lambda c: canonical(F.col(c), df.schema[c].dataType)
    pairs = [F.struct(F.lit(c).alias("key"), text(c).alias("value")) for c in foreign or []]
    keys = F.map_from_entries(F.array(*pairs)) if pairs else F.create_map().cast("map<string,string>")
    return df.where(F.col(key).isNotNull()).select(text(key).alias("pk"), row_hash(df.columns).alias("row_hash"), keys.alias("keys"))


@dataclass
class State:
    """What is known of a table between runs; version is that of its index of keys."""

    table: str
    version: int = 0
    watermark: str | None = None
    schema: str = ""
    rows: int = 0


class Store:
    """States and key indexes below one folder, an index for each table: rows by key, to which a run adds what changed.

    The state stands in the commit of the index's version, so that both count together or not at all.
    """

    INDEX = "pk string, row_hash string, keys map<string,string>"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _table(self, name: str) -> Keyed:
        return Keyed(self.spark, f"{self.path}/{name}", ["pk"], self.INDEX, self.buckets)

    def load(self, table: str) -> State:
        """The newest state of a table, empty where there is none."""
        held = self._table(table)
        said = held.meta()
        return State(table, held.version(), **said) if said else State(table)

    def index(self, state: State, keys: DataFrame | None = None) -> DataFrame:
        """The rows as of a state; with a few keys (pk), only the buckets that these are in."""
        table = self._table(state.table)
        if not state.version:
            return self.spark.createDataFrame([], self.INDEX)
        return table.read(None if keys is None else table.touched(keys), state.version)

    def save(self, state: State, rows: DataFrame, gone: DataFrame | None = None, base: bool = False, most: int = 8) -> State:
        """Adds rows, and marks for keys (pk) that are gone, as the next version; buckets with many such deltas are compacted."""
        table = self._table(state.table)
        said = {"watermark": state.watermark, "schema": state.schema, "rows": state.rows}
        table.write(rows, gone, said, base)
        table.compact(most)
        return State(state.table, table.version(), **said)


def sync(source: DataFrame, table: str, key: str, store: Store, foreign: list[str] | None = None, change_col: str | None = None, read: Callable | None = None) -> dict:
    """One run: what was added, updated, deleted and re-pointed since the last one, as DataFrames of keys, and the new state.

    By watermark where a column tells changes, else by row hash. By watermark only rows at or past it are read whole and
    hashed, the condition going down to the source, and only their buckets of the index are read for them; of all other
    rows the key alone is read, to find deletions. The index gets what changed, not a copy of itself. A changed
    schema starts afresh: all rows count as added, and keys of the old index that the source lacks as deleted. The first
    run deletes nothing; a second run without changes finds nothing. All is judged, and written, before the state is.
    read: as in Table, for sources that Spark hands no condition or choice of columns to.
    """
    state = store.load(table)
    drift = bool(state.schema) and state.schema != fingerprint(source)
    change_col = change_col or change_column(source)
    marked = bool(change_col) and not drift and state.watermark is not None
    if not marked:
        past = source
    elif read and source.schema[change_col].dataType.typeName() in ("integer", "long", "double", "string"):
        value = state.watermark if source.schema[change_col].dataType.typeName() == "string" else float(state.watermark) if "." in state.watermark else int(state.watermark)
        past = read(None, [(change_col, ">=", value)])
    else:
        past = changed_since(source, change_col, state.watermark)
    fresh = key_index(past, key, foreign)
    fresh = written(fresh, "fresh") if marked else fresh
    old = store.index(State(table) if drift else state, fresh if marked else None)
    both = fresh.join(old.select("pk", F.col("row_hash").alias("was"), F.col("keys").alias("had")), "pk", "left")
    known = F.col("was").isNotNull()
    changed = written(both.where(~known | (F.col("was") != F.col("row_hash"))).withColumn("action", F.when(known, "update").otherwise("add")), "changed")
    pairs = both.where(known) if marked else changed.where(known)
    pairs = pairs.select("pk", F.explode(F.map_entries("keys")).alias("e"), "had").select("pk", F.col("e.key").alias("column"), F.try_element_at("had", F.col("e.key")).alias("old_target"), F.col("e.value").alias("new_target"))
    moved = pairs.where(~F.col("old_target").eqNullSafe(F.col("new_target")))
    narrow = read([key], []) if read else source
    here = narrow.where(F.col(key).isNotNull()).select(canonical(F.col(key), source.schema[key].dataType).alias("pk"))
    gone = written(store.index(state).select("pk").join(here, "pk", "left_anti"), "gone")
    rows = narrow.count()
    if not change_col:
        mark = None
    else:  # later marks are among the rows past the one before
        mark = past.agg(F.max(change_col).cast("string")).first()[0] or (state.watermark if marked else None)
    new = store.save(State(table, state.version, mark, fingerprint(source), rows), changed.select("pk", "row_hash", "keys"), gone, base=not state.version)
    return {"delta": changed.select("pk", "action"), "deleted": gone, "moved": moved, "schema_changed": drift, "state": new}


def sync_all(tables: list, store: Store) -> dict[str, dict]:
    """Every table with a key, bridge tables left out; one that fails is reported with its error and stops no other."""
    out: dict[str, dict] = {}
    for t in sorted(tables, key=lambda t: (len(t.foreign) > 0, t.name)):
        if t.bridge:
            continue
        if not t.key:
            out[t.name] = {"error": "no key"}
            continue
        try:
            out[t.name] = sync(t.rows, t.name, t.key, store, list(t.foreign), read=t.read)
        except Exception as e:  # noqa: BLE001  reported, so that other tables go on
            out[t.name] = {"error": str(e)[:300]}
    return out

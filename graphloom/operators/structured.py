"""Typed filters, aggregation, key joins and top rows over tables or node properties, with pages.

Each takes a DataFrame whose columns are the properties. Columns that hold numbers already are
compared as numbers, so predicates reach the scan; strings follow the mixed rule of compare.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegralType, NumericType, TimestampNTZType, TimestampType

from graphloom.functions.expressions import bucket, compare, number

METRICS = ("count", "sum", "avg", "max", "min")
UPWARD = ("asc", "ascending", "min", "lowest", "smallest", "bottom", "least")


def _bounds(low: str, high: str) -> tuple[datetime, datetime] | None:
    """The times from the start of one prefix to the end of another of the same form: year, month, day or hour."""
    forms = {4: "%Y", 7: "%Y-%m", 10: "%Y-%m-%d", 13: "%Y-%m-%d %H"}
    if len(low) != len(high) or len(low) not in forms:
        return None
    try:
        start, last = (datetime.strptime(x, forms[len(low)]) for x in (low, high))
    except ValueError:
        return None
    if len(low) == 4:
        return start, last.replace(year=last.year + 1)
    if len(low) == 7:
        return start, (last.replace(day=28) + timedelta(days=4)).replace(day=1)
    return start, last + (timedelta(days=1) if len(low) == 10 else timedelta(hours=1))


def predicate(df: DataFrame, name: str, op: str, value) -> Column:
    """As compare, but in a form that is pushed to the scan: numbers against numeric columns, ranges of times against time columns."""
    symbols = {"=": "__eq__", "==": "__eq__", "!=": "__ne__", ">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__"}
    kind = df.schema[name].dataType
    if op in symbols and isinstance(kind, NumericType):
        try:
            # Whole numbers stay whole, so that long columns are compared exactly.
            target = int(value) if isinstance(kind, IntegralType) and str(value).strip().lstrip("+-").isdigit() else float(value)
            return getattr(F.col(name), symbols[op])(F.lit(target))
        except ValueError:
            pass
    if op == "date_range" and isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        low, _, high = str(value).partition("..")
        if bounds := _bounds(low, high):
            start, end = (F.lit(str(b)).cast(kind) for b in bounds)  # as text: in the session's time zone
            return (F.col(name) >= start) & (F.col(name) < end)
    return compare(F.col(name), op, value)


def among(df: DataFrame, columns: list[str], values: list) -> Column:
    """Whether one of the columns is among the values, which are cast to its type, so that scans can be pruned."""
    test = F.lit(False)
    for c in columns:
        kind = df.schema[c].dataType
        if isinstance(kind, IntegralType):
            typed = [int(v) for v in values if str(v).strip().lstrip("+-").isdigit()]
        else:
            typed = [F.lit(str(v)).cast(kind) for v in values]
        test = test | (F.col(c).isin(typed) if typed else F.lit(False))
    return test


def offset_of(cursor) -> int:
    """A cursor is the offset as text; anything else counts as 0."""
    try:
        return max(0, int(cursor))
    except (TypeError, ValueError):
        return 0


def page(df: DataFrame, order: list[Column], limit: int = 20, cursor=None) -> DataFrame:
    """Rows of one page in a total order."""
    return df.orderBy(*order).offset(offset_of(cursor)).limit(limit)


def page_info(total: int, limit: int, cursor=None) -> dict:
    start = offset_of(cursor)
    shown = max(0, min(limit, total - start))
    more = start + shown < total
    return {"total": total, "showing": shown, "offset": start, "has_more": more, "next_cursor": str(start + shown) if more else None}


def enveloped(df: DataFrame, order: list[Column], limit: int = 20, cursor=None) -> DataFrame:
    """One page with total, showing, offset, has_more and next_cursor beside each row; totals are one row."""
    start = offset_of(cursor)
    total = df.agg(F.count("*").alias("total"))
    shown = F.greatest(F.lit(0), F.least(F.lit(limit), F.col("total") - start))
    info = total.select("total", shown.cast("int").alias("showing"), F.lit(start).alias("offset"), (start + shown < F.col("total")).alias("has_more"))
    info = info.withColumn("next_cursor", F.when(F.col("has_more"), (F.lit(start) + F.col("showing")).cast("string")))
    return page(df, order, limit, cursor).crossJoin(F.broadcast(info))


def filter_nodes(df: DataFrame, name: str, op: str, value, from_ids: list | None = None, id_col: str | list[str] | None = None) -> DataFrame:
    """Rows whose property passes; from_ids keeps those whose id, or title, is listed."""
    out = df.where(predicate(df, name, op, value))
    return out if from_ids is None else out.where(among(df, [id_col] if isinstance(id_col, str) else list(id_col), from_ids))


def key_target(column: str, keys: dict[str, str], table: str = "") -> str | None:
    """The other table whose key has the column's name; keys: table to key column."""
    return next((t for t, k in sorted(keys.items()) if k == column and t != table), None)


def aggregate_nodes(
    df: DataFrame, group_by: str, metric: str = "count", metric_property: str | None = None, where: tuple | None = None, form: str = "", value_name: str = "value",
    from_ids: list | None = None, id_col: str | list[str] | None = None, keys: dict[str, str] | None = None, limit: int | None = None, cursor=None,
) -> DataFrame:
    """Rows (group, value): rows without the group are left out, missing metric values count as 0.

    With keys, groups by another table's key also get node_title; with a limit, the page of the largest values.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    if where:
        df = df.where(predicate(df, *where))
    if from_ids is not None:
        df = df.where(among(df, [id_col] if isinstance(id_col, str) else list(id_col), from_ids))
    group = bucket(F.col(group_by), form)
    if metric_property:
        numeric = isinstance(df.schema[metric_property].dataType, NumericType)
        m = F.coalesce(F.col(metric_property).cast("double") if numeric else number(F.col(metric_property)), F.lit(0.0))
    else:
        m = F.coalesce(number(F.col(group_by)), F.lit(1.0))
    value = F.count("*").cast("double") if metric == "count" else getattr(F, metric)(m)
    out = df.where(F.col(group_by).isNotNull()).groupBy(group.alias("group")).agg(value.alias(value_name))
    if target := key_target(group_by, keys or {}):
        out = out.withColumn("node_title", F.concat(F.lit(f"{target}:"), "group"))
    return out if limit is None else enveloped(out, [F.col(value_name).desc(), F.col("group")], limit, cursor)


def join_related(target: DataFrame, key: str, values: DataFrame, order: list[Column] | None = None, limit: int = 20, cursor=None) -> DataFrame:
    """Rows of target whose key is among the one column of values; a prefix "table:" is dropped. With an order, one page."""
    name = values.columns[0]
    text = F.col(name).cast("string")
    bare = F.when(text.rlike(r"^[0-9-]+$"), text).otherwise(F.regexp_replace(text, r"^[^:]*:", ""))
    # The values take the key's type, so that the join needs no cast of the large side.
    wanted = values.select(bare.try_cast(target.schema[key].dataType).alias("_value")).where("_value is not null").distinct()
    out = target.join(wanted, F.col(key) == F.col("_value"), "left_semi")
    return out if order is None else enveloped(out, order, limit, cursor)


def top_nodes(df: DataFrame, sort_by: str, order: str = "desc", limit: int = 5, tie: str = "id", cursor=None) -> DataFrame:
    """The first rows by a property: by number if every value spells one, else by text."""
    column = F.col(sort_by)
    if isinstance(df.schema[sort_by].dataType, NumericType):
        keys = [column]
    else:
        odd = df.where(column.isNotNull() & number(column).isNull()).limit(1)
        keys = [column.cast("string") if not odd.isEmpty() else number(column)]
    keys = [k.asc() if order.lower() in UPWARD else k.desc() for k in keys]
    return df.where(column.isNotNull()).orderBy(*keys, F.col(tie)).offset(offset_of(cursor)).limit(limit)


def count_nodes(nodes: DataFrame, kind: str | None = None, category: str | None = None, year: str | None = None) -> DataFrame:
    if kind:
        nodes = nodes.where(F.col("kind") == kind)
    if category:
        nodes = nodes.where(compare(F.col("properties")["category"], "contains", category))
    if year:
        nodes = nodes.where(F.col("properties")["year"] == str(year))
    return nodes.agg(F.count("*").alias("n"))


def newest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in order: the upsert's merge of old and new rows."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def validate(df: DataFrame, id_col: str, rules: list[tuple[str, str, bool]]) -> DataFrame:
    """Rows (id, errors) of rows that break a rule (property, type, required); errors are joined by "; "."""
    found = []
    for name, kind, required in rules:
        value = F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")
        if required:
            found.append(F.when(value.isNull() | (value == ""), F.lit(f"missing {name}")))
        if kind != "str":
            found.append(F.when(value.isNotNull() & (value != "") & value.try_cast({"int": "bigint", "float": "double", "bool": "boolean"}[kind]).isNull(), F.lit(f"{name} is not {kind}")))
    return df.select(F.col(id_col).alias("id"), F.concat_ws("; ", *found).alias("errors")).where("errors <> ''")


def scan(nodes: DataFrame, kind: str | None = None, level: int | None = None, limit: int = 100) -> DataFrame:
    """The newest nodes of a kind and a level, ties by id."""
    if kind is not None:
        nodes = nodes.where(F.col("kind") == kind)
    if level is not None:
        nodes = nodes.where(F.col("level") == level)
    return nodes.orderBy(F.col("updated_at").desc(), "id").limit(limit)


def by_property(nodes: DataFrame, name: str, value) -> DataFrame:
    """Nodes whose property is the value."""
    return nodes.where(F.try_element_at("properties", F.lit(name)) == str(value))


def hints(shown: int, total: int, query: str) -> list[str]:
    """What a reader may try next: fewer words where nothing was found, the next page where there is more."""
    if not total:
        words = query.split()
        return ["search for single words"] if len(words) > 1 else ["search for another word, or list the categories"]
    return ["read the next page, or filter further"] if shown < total else []

"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
BUCKETS = {"YYYY": 4, "YYYY-MM": 7, "YYYY-MM-DD": 10, "YYYY-MM-DD HH": 13}


def number(value: Column) -> Column:
    """The double a string spells, or null."""
    text = value.cast("string")
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def compare(value: Column, op: str, target) -> Column:
    """True where value op target holds; null values never hold, not even for !=.

    Both sides are compared as numbers where both spell one, else as strings. Also contains
    (any case), starts_with, and date_range with a target "from..to" of equal-length prefixes.
    """
    text, target = value.cast("string"), str(target)
    if op == "contains":
        test = F.instr(F.lower(text), F.lit(target.lower())) > 0 if target else F.lit(True)
    elif op == "starts_with":
        test = text.startswith(target)
    elif op == "date_range":
        low, dots, high = target.partition("..")
        test = F.substring(text, 1, len(low)).between(low, high) if dots and low and high else F.lit(False)
    elif op in ("=", "==", "!=", ">", ">=", "<", "<="):
        apply = {"=": lambda a, b: a == b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}[op]
        goal = number(F.lit(target))
        test = F.when(number(value).isNotNull() & goal.isNotNull(), apply(number(value), goal)).otherwise(apply(text, F.lit(target)))
    else:
        raise ValueError(f"unknown operator {op!r}")
    return F.coalesce(value.isNotNull() & test, F.lit(False))


def bucket(value: Column, form: str) -> Column:
    """The value's prefix for a date form; unknown forms leave it whole."""
    return F.substring(value.cast("string"), 1, BUCKETS[form]) if form in BUCKETS else value.cast("string")


def short_id(prefix: str, *parts: Column) -> Column:
    """prefix and 16 hex digits of the parts' MD5."""
    return F.concat(F.lit(prefix), F.substring(F.md5(F.concat_ws("->", *[p.cast("string") for p in parts])), 1, 16))


def occurrences(text: Column, term: str) -> Column:
    """Times that a term stands in a text without overlap."""
    return (F.length(text) - F.length(F.replace(text, F.lit(term)))) / F.lit(len(term))


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for zero vectors or different lengths."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def rank_score(rank: Column) -> Column:
    """Score of the seed at a rank counted from 0."""
    return F.greatest(F.lit(0.10), F.lit(0.95) - F.lit(0.03) * rank)


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def snippet(text: Column, terms: list[str], length: int = 240) -> Column:
    """The first sentence with the most distinct terms, or the text's beginning."""
    parts = F.filter(F.transform(F.split(text, r"[.。\n]+"), lambda s: F.trim(s)), lambda s: s != "")
    scored = F.transform(parts, lambda s, i: F.struct(total([F.contains(F.lower(s), F.lit(t.lower())).cast("int") for t in terms]).alias("n"), (-i).alias("i"), s.alias("s")))
    best = F.array_max(scored)
    return F.substring(F.when(best["n"] > 0, best["s"]).otherwise(text), 1, length)

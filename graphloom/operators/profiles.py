"""Profiles of a corpus: what its rules should know, learned from it or written down, as TOML; and facts about a table's columns."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import documents

#: What a number and a date look like as text.
NUMBER, DATE = r"^[+-]?\d+(\.\d+)?$", r"^\d{4}-\d{2}-\d{2}"


@dataclass(frozen=True)
class Profile:
    """Settings of ingest and search for one corpus. Patterns are regular expressions, as text."""

    name: str
    locale: str = "multi"
    stopwords_extra: tuple[str, ...] = ()
    metadata_strip_patterns: tuple[str, ...] = ()
    reference_patterns: tuple[str, ...] = ()
    entity_hint_patterns: tuple[str, ...] = ()
    min_df: int = 3
    max_df_ratio: float = 0.3
    min_phrase_len: int = 3
    max_phrase_len: int = 20
    enrich_document_content: bool = True
    document_preview_chars: int = 600
    reference_token_pattern: str = ""
    reference_key_property: str = ""
    reference_scope_property: str = ""
    reference_crossscope_pattern: str = ""
    ontology_hints: dict[str, str] = field(default_factory=dict)
    authority_by_kind: dict[str, int] = field(default_factory=dict)
    kind_query_hints: dict[str, list[str]] = field(default_factory=dict)
    table_query_hints: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def generic(cls, locale: str = "multi") -> Profile:
        return cls(f"generic_{locale}", locale)

    @classmethod
    def with_references(cls, key_property: str, scope_property: str = "", crossscope_pattern: str = "", name: str = "references", locale: str = "multi") -> Profile:
        """For documents that cite each other by a key of their own, inside a scope or beyond it."""
        return cls(name, locale, reference_key_property=key_property, reference_scope_property=scope_property, reference_crossscope_pattern=crossscope_pattern)

    def with_hints(self, **more) -> Profile:
        return replace(self, **more)

    def stop_words(self) -> frozenset[str]:
        """The language's words that make no phrase, and the corpus's own."""
        return (T.STOP if self.locale in ("en", "multi") else frozenset()) | frozenset(self.stopwords_extra)

    def save(self) -> str:
        """As TOML: plain values first, then a table for each map."""
        plain = [f"{f.name} = {_toml(getattr(self, f.name))}" for f in fields(self) if not isinstance(getattr(self, f.name), dict)]
        tables = [f"\n[{f.name}]\n" + "\n".join(f"{_toml(k)} = {_toml(v)}" for k, v in getattr(self, f.name).items()) for f in fields(self) if isinstance(getattr(self, f.name), dict) and getattr(self, f.name)]
        return "\n".join([*plain, *tables]) + "\n"

    @classmethod
    def load(cls, text: str) -> Profile:
        """From TOML; names that a profile does not have are an error."""
        said = tomllib.loads(text)
        known = {f.name for f in fields(cls)}
        if wrong := sorted(set(said) - known):
            raise ValueError(f"a profile has no {wrong}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in said.items()})


def _toml(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_toml, value)) + "]"
    named = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\t": "\\t", "\r": "\\r"}
    return '"' + "".join(named.get(c, c if c >= " " and c != "\x7f" else f"\\u{ord(c):04x}") for c in value) + '"'


def generate(docs: DataFrame, name: str, share: float = 0.6, text_col: str = "text", category_col: str | None = None) -> Profile:
    """A profile learned from all texts: their language by letters, and words that stand in a share of them.

    Categories that are named for a kind of node (rules, lessons, decisions ...) become hints. One pass finds the
    letters, one the frequent words; a few dozen rows come to the driver.
    """
    texts = docs.where(F.trim(F.coalesce(F.col(text_col), F.lit(""))) != "").select(F.col(text_col).alias("text"))
    counts = {"ko": "[가-힣]", "ja": "[ぁ-ゟァ-ヿ]", "en": "[A-Za-z]", "all": r"\S"}
    seen = texts.agg(*[F.sum(F.regexp_count("text", F.lit(p))).alias(k) for k, p in counts.items()]).first()
    if not seen["all"]:
        return Profile(name)
    top = max(("ko", "ja", "en"), key=lambda k: seen[k])
    locale = top if 2 * seen[top] >= seen["all"] else "multi"
    words = [r.token for r in documents.stopword_suggestions(texts, share).collect()]
    fits = {"ko": lambda w: w >= "가", "en": lambda w: w.isascii()}.get(locale, lambda w: True)
    hints = {}
    if category_col:
        labels = docs.select(F.col(category_col).alias("label")).where("label is not null").distinct()
        kind = T.classify_kind(F.col("label"), F.lit(""))
        # Labels that no rule names are left to the user; a few hundred categories are a corpus's usual number.
        hints = {r.label: r.kind for r in labels.select("label", kind["kind"].alias("kind"), kind["confidence"].alias("sure")).where("sure > 0").orderBy("label").limit(1000).collect()}
    return Profile(name, locale, stopwords_extra=tuple(w for w in words if fits(w)), ontology_hints=hints)


def column_facts(df: DataFrame) -> DataFrame:
    """Rows (column, rows, nulls, distinct, shortest, longest, numbers, dates) of all columns as text, by one pass.

    distinct is estimated by HyperLogLog; all other figures are exact.
    """
    told = []
    for c in df.columns:
        text = F.col(f"`{c}`").cast("string")
        told.append(F.struct(
            F.lit(c).alias("column"), F.count("*").alias("rows"), F.count(F.when(text.isNull(), 1)).alias("nulls"), F.approx_count_distinct(text).alias("distinct"),
            F.min(F.length(text)).alias("shortest"), F.max(F.length(text)).alias("longest"), F.count(F.when(text.rlike(NUMBER), 1)).alias("numbers"), F.count(F.when(text.rlike(DATE), 1)).alias("dates"),
        ))
    return df.agg(F.array(*told).alias("told")).select(F.explode("told").alias("f")).select("f.*")


def column_roles(facts: DataFrame) -> DataFrame:
    """Rows (column, role) by a table's facts: key, date, number, category, text, or empty.

    A key has a value in every row and nearly as many different ones as rows; a category has few different values for its rows.
    """
    filled = F.col("rows") - F.col("nulls")
    role = F.when(filled == 0, "empty").when((F.col("nulls") == 0) & (F.col("longest") <= 64) & (F.col("distinct") >= 0.9 * F.col("rows")) & (F.col("dates") == 0), "key")
    role = role.when(F.col("dates") >= 0.9 * filled, "date").when((F.col("distinct") <= 50) & (F.col("distinct") * 20 <= filled), "category").when(F.col("numbers") >= 0.9 * filled, "number").otherwise("text")
    return facts.select("column", role.alias("role"))

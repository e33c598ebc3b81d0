"""Quality rules as a short-circuit cascade.

A rule rejects a text by facts about it. On a sample, whose size is a parameter, each fact is timed and
each rule judged. The rules are then ordered by rejections for each second: the next rule is the one
that rejects most of the sample's texts that are still there for what its facts cost, without facts
that are at hand already. All texts then go through the rules in that order and stop at the first
that rejects them; facts are made only when a rule asks for them. The order changes the cost and
which rule is named, never the verdict.

Defined cases: a null text, and one of white space alone, has no words and all its counts are 0; very
long texts are judged whole; repeated rows are judged each; with an empty table, or a sample without
rows, the order is the one given; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTER = re.compile("[A-Za-z\x80-\U0010ffff]")
SYMBOLS = "#*$%&|<>"
NO_SYMBOL = str.maketrans("", "", SYMBOLS)
WINDOW = 5


class Facts:
    """Facts about one text, each made when it is first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    def __getattr__(self, name: str):
        if name not in FACTS:
            raise AttributeError(name)
        value = FACTS[name][1](self)
        setattr(self, name, value)
        return value


def repeated(words: list[str], n: int = WINDOW) -> int:
    """Words in windows of n words that are found twice or more in the text, each word counted once."""
    if len(words) <= n:
        return 0
    word = pd.factorize(np.array(words, object))[0].astype(np.int64)
    # Windows that double, and then reach n, numbered anew each time: equal numbers are equal windows.
    code, size = word, 1
    while size < n:
        step = min(size, n - size)
        code = pd.factorize(code[: len(code) - step] * len(words) + code[step:])[0].astype(np.int64)
        size += step
    twice = np.flatnonzero(np.bincount(code)[code] > 1)
    if not len(twice):
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + n, -1)
    return int((np.cumsum(cover) > 0).sum())


#: Each fact with the facts that it is made from.
FACTS: dict[str, tuple[tuple[str, ...], Callable[[Facts], object]]] = {
    "words": ((), lambda t: WORD.findall(t.text)),
    "lines": ((), lambda t: [x for x in t.text.split("\n") if WORD.search(x)]),
    "n_words": (("words",), lambda t: len(t.words)),
    "n_lines": (("lines",), lambda t: len(t.lines)),
    "word_chars": (("words",), lambda t: sum(map(len, t.words))),
    "n_symbols": ((), lambda t: len(t.text) - len(t.text.translate(NO_SYMBOL))),
    "n_dup_lines": (("lines",), lambda t: len(t.lines) - len(set(t.lines))),
    "n_repeat_words": (("words",), lambda t: repeated(t.words)),
    "n_letter_words": (("words",), lambda t: sum(LETTER.search(w) is not None for w in t.words)),
    "n_bullets": (("lines",), lambda t: sum(x.lstrip(" \t").startswith(("-", "*", "•")) for x in t.lines)),
    "n_cut_lines": (("lines",), lambda t: sum(x.rstrip(" \t\r").endswith(("...", "…")) for x in t.lines)),
}


@dataclass(frozen=True)
class Rule:
    """A rule by name, the facts that it asks for, and whether it rejects a text with these facts."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Facts], bool]


#: The first two are the base; the others reject what no prose of any language is.
RULES = [
    Rule("few_words", ("n_words",), lambda t: t.n_words < 10),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda t: 100 * t.n_repeat_words > 20 * t.n_words),
    Rule("symbols", ("n_words", "n_symbols"), lambda t: 10 * t.n_symbols > t.n_words),
    Rule("word_length", ("n_words", "word_chars"), lambda t: not 2 * t.n_words <= t.word_chars <= 25 * t.n_words),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda t: 2 * t.n_dup_lines > t.n_lines),
    Rule("few_letters", ("n_words", "n_letter_words"), lambda t: 2 * t.n_letter_words < t.n_words),
    Rule("bullets", ("n_lines", "n_bullets"), lambda t: t.n_lines >= 5 and 10 * t.n_bullets > 9 * t.n_lines),
    Rule("cut_lines", ("n_lines", "n_cut_lines"), lambda t: t.n_lines >= 5 and 10 * t.n_cut_lines > 3 * t.n_lines),
]


def asked(needs: Sequence[str]) -> list[str]:
    """These facts and all that they are made from, those first."""
    out: list[str] = []
    for name in needs:
        out += [x for x in [*asked(FACTS[name][0]), name] if x not in out]
    return out


def ordered(rules: Sequence[Rule], cost: dict[str, float], rejects: np.ndarray, at_hand: Sequence[str] = (), least: float = 1e-9) -> list[Rule]:
    """Rules by rejection for cost; rejects: which rule (column) rejects which text of the sample (row).

    Facts at hand, and those of rules that come before, cost nothing more; only texts that no earlier rule
    rejects count. Ties keep the order given.
    """
    left, out, have = list(range(len(rules))), [], set(asked(at_hand))
    alive = np.ones(len(rejects), bool)
    while left:

        def worth(i: int) -> float:
            price = sum(cost.get(x, 0.0) for x in asked(rules[i].needs) if x not in have) + least
            return rejects[alive, i].sum() / price

        best = max(left, key=worth)
        left.remove(best)
        out.append(rules[best])
        have |= set(asked(rules[best].needs))
        alive &= ~rejects[:, best]
    return out


def measured(docs: DataFrame, rules: Sequence[Rule], sample: int = 2000, seed: int = 7, text_col: str = "text") -> tuple[dict[str, float], np.ndarray]:
    """Mean seconds of each fact, and which rule rejects which text, on some rows drawn at random.

    About as many rows as sample says, whatever the table's size; each gives a few numbers.
    """
    names = asked([x for r in rules for x in r.needs])
    n = docs.count()
    rows = docs.select(text_col) if n <= sample else docs.select(text_col).sample(sample / n, seed)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text in b[text_col]:
                facts, took = Facts(text), []
                for name in names:
                    began = time.perf_counter()
                    getattr(facts, name)
                    took.append(time.perf_counter() - began)
                out.append((took, [r.rejects(facts) for r in rules]))
            yield pd.DataFrame(out, columns=["took", "rejects"])

    got = rows.mapInPandas(each, "took array<double>, rejects array<boolean>").collect()
    took = np.array([r.took for r in got]).reshape(len(got), len(names))
    return dict(zip(names, took.mean(0).tolist() if len(got) else [0.0] * len(names), strict=True)), np.array([r.rejects for r in got], bool).reshape(len(got), len(rules))


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, facts: Sequence[str] = (), sample: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, the facts asked for, kept, rejected_by, n_rules).

    Facts (counts) that are asked for are made for every text. rejected_by names the first rule, in the order
    chosen, that rejects the text, null if none; n_rules is the number of rules that the text went through.
    """
    kind = dict(docs.dtypes)[id_col]
    order = ordered(rules, *measured(docs, rules, sample, text_col=text_col), facts)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["text"]:
                about, by = Facts(text), None
                for n, rule in enumerate(order, 1):  # noqa: B007  n is read below
                    if rule.rejects(about):
                        by = rule.name
                        break
                rows.append((*(getattr(about, x) for x in facts), by is None, by, n if order else 0))
            out = pd.DataFrame(rows, columns=[*facts, "kept", "rejected_by", "n_rules"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    # Ids go through as text: pandas would make floats of longs beside a null.
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    counts = "".join(f"{x} long, " for x in facts)
    out = rows.mapInPandas(each, f"doc_id string, {counts}kept boolean, rejected_by string, n_rules int")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return cascade(docs, facts=counts).select("doc_id", *counts, failed.alias("base_failed"), "kept")


OP13_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from documents
), win as (select r, i, array_to_string(w[i : i + 4], ' ') as s from (select r, w, unnest(generate_series(1, len(w) - 4)) as i from d where len(w) > 4)),
twice as (select r, s from win group by r, s having count(*) > 1),
covered as (select r, count(distinct p) as n from (select r, unnest(generate_series(i, i + 4)) as p from win join twice using (r, s)) group by r),
f as (
  select doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words,
    len(lines) as n_lines, len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]'))) as n_letter_words,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t]*[-*•]'))) as n_bullets, len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\r]*$'))) as n_cut
  from d left join covered using (r)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or 10 * n_symbols > n_words or word_chars < 2 * n_words or word_chars > 25 * n_words or 2 * n_dup_lines > n_lines
    or 2 * n_letter_words < n_words or (n_lines >= 5 and 10 * n_bullets > 9 * n_lines) or (n_lines >= 5 and 10 * n_cut > 3 * n_lines)) as kept
from f
"""

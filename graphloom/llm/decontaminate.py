"""Benchmark decontamination by winnowing, in DataFrame functions only.

In every window of words the k-gram with the smallest hash is kept, so that any shared run of a
window's length shares a kept k-gram. The kept k-grams of documents and of benchmark items meet in
a join, and each hit is extended: the windows around it are compared word by word in both texts.
Items shorter than a window are one window of their own length, and meet by its whole hash.

Defined cases: a null or empty text has no words, an item without words no window; words are
compared as they are after lower-casing A-Z; repeated items with equal ids count once, items with
null ids mark words but are not listed; repeated documents give repeated rows; empty tables give no
rows, or no hits; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.keys import KEY, keyed, stored

WINDOW = 13
GRAM = 9
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, A-Z lowered."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def upto(first: int, last: Column) -> Column:
    """first..last, or nothing."""
    return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))


def kept_grams(w: Column, window: int, gram: int) -> Column:
    """Structs (pos, h): in each window the k-gram with the least hash, the last of equal ones."""
    span = window - gram + 1

    def last_least(g: Column, i: Column) -> Column:
        pick = None
        for j in range(span - 1, 0, -1):
            before = [F.get(g, i + x) for x in range(j)]
            test = F.get(g, i + j) <= (F.least(*before) if j > 1 else before[0])
            pick = F.when(test, i + j) if pick is None else pick.when(test, i + j)
        return pick.otherwise(i)

    def of_grams(g: Column) -> Column:
        at = F.array_distinct(F.transform(upto(0, F.size(g) - span), lambda i: last_least(g, i)))
        return F.transform(at, lambda p: F.struct(p.alias("pos"), F.get(g, p).alias("h")))

    def of_hashes(h: Column) -> Column:
        return let(F.transform(upto(0, F.size(h) - gram), lambda i: F.xxhash64(F.slice(h, i + 1, gram))), of_grams)

    hashed = let(F.transform(w, lambda x: F.xxhash64(x)), of_hashes)
    return F.when(F.size(w) >= window, hashed).otherwise(F.array().cast("array<struct<pos:int,h:bigint>>"))


def every_gram(n: int) -> Column:
    """Structs (pos, h) of all runs of n words of the column w."""
    return F.transform(upto(0, F.size("w") - n), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice("w", i + 1, n)).alias("h")))


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, share: int = 20, keep_keys: bool = False) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every document.

    contaminated: at least one word in share is inside a benchmark window. keep_keys adds the row key.
    """
    src = keyed(docs, id_col, text_col)
    items = bench.select(F.col(item_col).alias("item"), words(F.col(item_text)).alias("w")).distinct().withColumn("n", F.size("w"))
    items = stored(items.where("n > 0"), "items")
    margin = window - gram
    long = items.where(F.col("n") >= window).select("item", "w", F.explode(kept_grams(F.col("w"), window, gram)).alias("x"))
    left = F.least(F.col("x.pos"), F.lit(margin))
    long = long.select(F.lit(window).alias("size"), F.col("x.h").alias("h"), "item", left.alias("left"), F.slice("w", F.col("x.pos") - left + 1, left + gram + margin).alias("around"))
    short = items.where(F.col("n") < window).select(F.col("n").alias("size"), F.xxhash64("w").alias("h"), "item", F.lit(0).alias("left"), F.col("w").alias("around"))
    # Equal surroundings of one hash are compared once for all their items.
    prints = long.union(short).groupBy("size", "h", "left", "around").agg(F.collect_set("item").alias("items"), F.max(F.col("item").isNull()).alias("unnamed"))
    prints = stored(prints, "prints")

    text = src.select(*KEY, words(F.col("text")).alias("w"))
    kept = text.select(*KEY, F.explode(kept_grams(F.col("w"), window, gram)).alias("x")).select(*KEY, F.lit(window).alias("size"), "x.pos", "x.h")
    sizes = sorted(r["size"] for r in items.where(F.col("n") < window).select(F.col("n").alias("size")).distinct().collect())  # at most window - 1 numbers
    for n in sizes:
        kept = kept.union(text.select(*KEY, F.explode(every_gram(n)).alias("x")).select(*KEY, F.lit(n).alias("size"), "x.pos", "x.h"))
    hits = kept.join(prints, ["size", "h"]).groupBy(*KEY).agg(F.collect_set(F.struct("pos", "size", "left", "around", "items")).alias("hits"))

    def starts(w: Column, x: Column) -> Column:
        """Where the windows begin that extend the hit in both texts alike."""
        base = x["pos"] - x["left"]
        same = lambda o: (base + o >= 0) & (base + o + x["size"] <= F.size(w)) & (F.slice(x["around"], o + 1, x["size"]) == F.slice(w, F.greatest(base + o, F.lit(0)) + 1, x["size"]))
        return F.transform(F.filter(upto(0, F.size(x["around"]) - x["size"]), same), lambda o: base + o)

    item_type = dict(bench.dtypes)[item_col]

    def found(w: Column) -> Column:
        each = F.transform("hits", lambda x: F.struct(x["size"].alias("size"), x["items"].alias("items"), starts(w, x).alias("starts")))
        real = F.filter(each, lambda x: F.size(x["starts"]) > 0)
        return F.struct(F.size(w).cast("long").alias("n_words"), F.coalesce(real, F.array().cast(f"array<struct<size:int,items:array<{item_type}>,starts:array<int>>>")).alias("real"))

    def result(w: Column) -> Column:
        return let(found(w), lambda f: F.struct(
            f["n_words"].alias("n_words"),
            F.size(F.array_distinct(F.flatten(F.transform(f["real"], lambda x: F.flatten(F.transform(x["starts"], lambda s: F.sequence(s, s + x["size"] - 1))))))).cast("long").alias("n_hit"),
            F.array_sort(F.transform(F.array_distinct(F.flatten(F.transform(f["real"], lambda x: x["items"]))), lambda i: i.cast("string"))).alias("items"),
        ))

    joined = src.join(hits, KEY, "left").select("doc_id", *KEY, let(words(F.col("text")), result).alias("r"))
    return joined.select(
        "doc_id", "r.n_words", "r.n_hit", F.size("r.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("r.items", ","), 256).alias("items_sha256"),
        ((F.col("r.n_hit") > 0) & (share * F.col("r.n_hit") >= F.col("r.n_words"))).alias("contaminated"),
        *(KEY if keep_keys else []),
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

"""Row keys, shared scratch folders and connected components for the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["rk", "rk2"]


def key_columns(id_col: str, text_col: str) -> list:
    """A 96-bit key of id and text, as two columns."""
    return [F.xxhash64(F.col(id_col), F.col(text_col)).alias("rk"), F.hash(F.col(text_col), F.col(id_col)).alias("rk2")]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only id, text and the key of the two, so that rows can be found again.

    Rows that repeat both share a key, and share every result; null ids and texts have keys too.
    """
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *key_columns(id_col, text_col))


def with_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (row, rk, rk2): all columns as one struct, so that none of them can clash, and the key."""
    return docs.select(F.struct(*docs.columns).alias("row"), *key_columns(id_col, text_col))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; that is set only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        import tempfile

        root = spark.sparkContext.getCheckpointDir()
        if not root and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = root or tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored tables of one call by name, so that each can be deleted after its last reader."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """As above; a table of the same name that was stored before is deleted once this one is written."""
        path, old = scratch(self.spark, name), self.paths.get(name)
        df.write.parquet(path)
        self.paths[name] = path
        if old:
            delete(self.spark, old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) as rows (node, comp), comp the smallest node.

    Alternates large-star and small-star rounds; every round is grouped and joined by Spark
    and written to the shared folder, where it takes the place of the one before. Nothing is
    collected but one count for each round.
    """
    held = Scratch(edges.sparkSession)

    def sign(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        return row[0], row[1]

    nxt = held.stored(edges.select("a", "b").where("a <> b").distinct(), "cc")
    before, now = None, sign(nxt)
    while before != now:
        e = nxt
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        nxt = held.stored(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "cc")
        before, now = now, sign(nxt)
    comp = nxt.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp"))
    roots = nxt.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return comp.union(roots.join(comp, "node", "left_anti"))

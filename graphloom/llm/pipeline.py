"""A training corpus from raw documents: five stages, each written before the next one reads it.

Defined cases, for every stage: null ids, and ids that rows share, are judged by the rows' own texts; null and empty
texts are neither toxic, copies, contaminated nor secret, and are packed as the end id alone; rows that repeat id and
text are copies if they have words, and stay else; an empty table gives no rows; further columns, whatever their
names, pass all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, jaccard_join, packing, secrets, toxicity
from graphloom.llm.keys import KEY, stored, with_key


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on all labelled rows, does not mark."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels)
    return docs.where(toxicity.score_column(spark, model, docs["text"]) < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at 0.8 on five words, one row: that of the smallest id, null ids last.

    Texts without words link with nothing, so all their rows stay.
    """
    rows = jaccard_join.link_documents(docs, shingle=5, num=80, den=100, keep_keys=True)
    alone = F.when(F.col("comp").isNull(), F.struct(*KEY))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *KEY)).alias("first")
    kept = rows.groupBy("comp", alone.alias("alone")).agg(first).select("first.rk", "first.rk2", F.col("alone").isNotNull().alias("every"))
    # Rows that repeat id and text share a key: the first of them in the other columns' order stays.
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy("row"))
    return with_key(docs).join(kept, KEY).withColumn("nth", nth).where("every or nth = 1").select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share less than a twentieth of their words with the benchmark."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bad = decontaminate.decontaminate(docs, bench, keep_keys=True).where("contaminated").select(*KEY).distinct()
    return with_key(docs).join(bad, KEY, "left_anti").select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their token ids, in sequences and balanced step groups."""
    return packing.pack_groups(docs, keep_ids=True)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("decontamination", drop_contaminated), ("secrets", redact_secrets), ("packing", pack)]

#: Toxicity is trained and packing is cut by a tokenizer, which SQL can't express; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents; earlier stages are written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

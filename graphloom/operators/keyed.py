"""Tables by key that grow by deltas: written by bucket of the key, merged when read, compacted where deltas pile up.

A write adds one version: whole rows of the keys that changed, and marks for keys that are gone, dealt out by a hash of
the key. Only buckets with changes get files. A version counts once its commit is written, so a write that fails, or is
run again, leaves what was there; each version can be read as long as it is not cleaned away.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

COMMIT = "version int, base boolean, buckets array<int>, meta string"


class Keyed:
    """A table of rows by key below one folder. Rows of one write must not repeat a key; rows without one are left out."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: StructType | str, buckets: int = 32):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def bucket(self) -> Column:
        """The bucket of a row, by its key."""
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.key]), F.lit(self.buckets)).cast("int")

    def commits(self) -> list:
        """A few numbers for each write, oldest first."""
        try:
            found = self.spark.read.schema(COMMIT).parquet(f"{self.path}/commits").collect()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            found = []
        return sorted(found, key=lambda r: r.version)

    def version(self) -> int:
        return max((c.version for c in self.commits()), default=0)

    def meta(self) -> dict:
        """What the newest commit that says something says."""
        return next((json.loads(c.meta) for c in reversed(self.commits()) if c.meta), {})

    def _files(self, version: int, names: list[int] | None) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField("_gone", BooleanType()), StructField("_bucket", IntegerType())])
        df = self.spark.read.schema(schema).parquet(f"{self.path}/rows/v{version}").withColumn("_version", F.lit(version))
        return df if names is None else df.where(F.col("_bucket").isin(names))

    def read(self, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The rows, of some buckets or all, as of a version or the newest."""
        commits = [c for c in self.commits() if version is None or c.version <= version]
        whole = {b: max((c.version for c in commits if c.base and b in c.buckets), default=0) for b in range(self.buckets)}
        wanted = set(range(self.buckets) if buckets is None else buckets)
        base, delta = [], []
        for c in commits:
            live = [b for b in c.buckets if b in wanted and c.version >= whole[b]]
            if live:
                # Partition columns: buckets that are not asked for, or were compacted since, are never opened.
                (base if c.base else delta).append(self._files(c.version, None if len(live) == len(c.buckets) else live))
        none = self.spark.createDataFrame([], self.schema)
        old = reduce(DataFrame.unionByName, base).select(self.schema.names) if base else none
        if not delta:
            return old
        newest = Window.partitionBy(*self.key).orderBy(F.desc("_version"))
        new = reduce(DataFrame.unionByName, delta).withColumn("_n", F.row_number().over(newest)).where("_n = 1")
        # The large base is not shuffled by this where the deltas are small enough for Spark to broadcast their keys.
        return old.join(new.select(*self.key), self.key, "left_anti").unionByName(new.where("not _gone").select(self.schema.names))

    def write(self, rows: DataFrame, gone: DataFrame | None = None, meta: dict | None = None, base: bool = False, within: list[int] | None = None) -> int:
        """Add a version with these rows in place of those of their keys, and without the keys of gone.

        base: the rows are all rows of the buckets in within (None: of every bucket). Returns the version.
        """
        version = self.version() + 1
        out = rows.select(*self.schema.names, F.lit(False).alias("_gone"))
        if gone is not None:
            nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name not in self.key]
            out = out.unionByName(gone.select(*self.key, *nulls, F.lit(True).alias("_gone")))
        out = out.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in self.key]))
        at = f"{self.path}/rows/v{version}"
        out.withColumn("_bucket", self.bucket()).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(at)
        names = (list(range(self.buckets)) if within is None else within) if base else sorted(r[0] for r in self._files(version, None).select("_bucket").distinct().collect())
        commit = self.spark.createDataFrame([(version, base, names, json.dumps(meta) if meta is not None else None)], COMMIT)
        commit.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return version

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets that rows with these keys are in: a number for each at most."""
        return sorted(r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect())

    def compact(self, most: int = 8) -> list[int]:
        """Write the buckets that more than so many deltas were added to since their base as one base; gives their numbers."""
        commits = self.commits()
        whole = {b: max((c.version for c in commits if c.base and b in c.buckets), default=0) for b in range(self.buckets)}
        full = [b for b in range(self.buckets) if sum(b in c.buckets for c in commits if c.version > whole[b]) > most]
        if full:
            self.write(self.read(full), base=True, within=full)
        return full

    def clean(self) -> int:
        """Delete the files of buckets that a later base has replaced; older versions of them cannot be read any more. Gives their number."""
        commits, n = self.commits(), 0
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for c in commits:
            for b in c.buckets:
                if any(x.base and b in x.buckets and x.version > c.version for x in commits):
                    at = path(f"{self.path}/rows/v{c.version}/_bucket={b}")
                    n += bool(at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))
        return n

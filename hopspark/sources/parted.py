"""Tables in partitions by a key's hash, so that an upsert rewrites the partitions it touches and no others.

Partitions are replaced by Spark's dynamic partition overwrite.  That isn't one step for
all of them: who reads while an upsert is written may see some partitions before and
some after it, and readers of such a table should wait for its writer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopspark.sources.scratch import scratch_table

#: Rows of a partition, where the number of partitions isn't given.
PART_ROWS = 1_000_000


@dataclass(frozen=True)
class Parted:
    """A table at ``path`` with ``key`` in ``parts`` partitions."""

    spark: SparkSession
    path: str
    key: str
    parts: int
    schema: str

    def rows(self) -> DataFrame:
        return self._whole().drop("part")

    def _whole(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, part int").parquet(f"{self.path}/rows")

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("part", F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int"))

    def _write(self, placed: DataFrame) -> None:
        placed.repartition(self.parts, "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.path}/rows")

    def upsert(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the partitions that hold keys of ``new`` by ``merge(stored, new)`` of each, and name them.

        ``merge``: such as :func:`hopspark.sources.sinks.upsert_papers`.  The merged rows
        are written to the shared folder first, so that nothing is read from where it is
        being replaced.  An upsert that failed before it replaced anything may be repeated.
        """
        new = scratch_table(self._placed(new), "upsert-new")
        touched = sorted(r.part for r in new.select("part").distinct().collect())  # as many as partitions at most
        if not touched:
            return []
        stored = self._whole().where(F.col("part").isin(touched))
        self._write(scratch_table(self._placed(merge(stored.drop("part"), new.drop("part"))), "upsert-merged"))
        return touched


def store_parted(df: DataFrame, path: str, key: str, parts: int | None = None) -> Parted:
    """Store ``df``; by default in a partition for each PART_ROWS rows."""
    parts = parts or max(1, -(-df.count() // PART_ROWS))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    table = Parted(df.sparkSession, path, key, parts, schema)
    table._write(table._placed(df))
    df.sparkSession.createDataFrame([(key, parts, schema)], "key string, parts int, schema string").coalesce(1).write.parquet(f"{path}/meta")
    return table


def open_parted(spark: SparkSession, path: str) -> Parted:
    meta = spark.read.schema("key string, parts int, schema string").parquet(f"{path}/meta").first()
    return Parted(spark, path, meta.key, meta.parts, meta.schema)

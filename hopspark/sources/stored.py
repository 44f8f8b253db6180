"""Tables stored by key: graph and chunks in buckets, so that what looks rows up is dealt to them and not they to it.

Buckets are Spark's own; the catalog only sees a table while it is written or opened.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopspark.operators.graph import undirected
from hopspark.sources.scratch import scratch_table

#: Rows of a bucket, and bytes of texts, where the number of buckets isn't given.
BUCKET_ROWS, BUCKET_BYTES = 1_000_000, 64_000_000


def _name() -> str:
    return f"hopspark_{uuid.uuid4().hex}"


def write_buckets(df: DataFrame, path: str, key: str, buckets: int, mode: str = "error", distinct: bool = False) -> None:
    """``df`` in ``buckets`` by ``key``, sorted inside; ``mode`` append adds a file to each bucket, ``distinct`` leaves repeats out."""
    spark, name = df.sparkSession, _name()
    rows = df.repartition(buckets, key)
    # repeats lie in one bucket: they aren't shuffled once more
    writer = (rows.distinct() if distinct else rows).sortWithinPartitions(key).write.option("path", path).bucketBy(buckets, key).sortBy(key)
    if mode == "append":
        _declare(spark, name, path, df, key, buckets)
        writer = writer.mode("append")
    try:
        writer.saveAsTable(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _declare(spark: SparkSession, name: str, path: str, like: DataFrame, key: str, buckets: int) -> None:
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")


def open_buckets(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    """A table of :func:`write_buckets`, of which Spark knows how it lies."""
    name = _name()
    _declare(spark, name, path, spark.read.parquet(path), key, buckets)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def _buckets(spark: SparkSession, path: str) -> int:
    return spark.read.schema("buckets int").parquet(f"{path}/meta").first().buckets


def _write_meta(spark: SparkSession, path: str, buckets: int) -> None:
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/meta")


@dataclass(frozen=True)
class StoredGraph:
    """Edges from either end by entity, their ends by chunk, and counts of ends by entity."""

    spark: SparkSession
    path: str
    buckets: int

    def _table(self, name: str, key: str) -> DataFrame:
        return open_buckets(self.spark, f"{self.path}/{name}", key, self.buckets)

    def adjacency(self) -> DataFrame:
        """(entity, other, chunk_id), in buckets by entity."""
        return self._table("adjacency", "entity")

    def degrees(self) -> DataFrame:
        """(entity, degree): what each append counted, added up where it lies."""
        return self._table("degrees", "entity").groupBy("entity").agg(F.sum("degree").alias("degree"))

    def ends(self) -> DataFrame:
        """(chunk_id, entity), in buckets by chunk."""
        return self._table("ends", "chunk_id")

    def append(self, edges: DataFrame, mode: str = "append") -> None:
        """Add edges; repeated ones count again for degrees, as rows of an edge table do."""
        self._add(scratch_table(edges.select("source_entity_id", "target_entity_id", "source_chunk_id"), "added-edges"), mode)

    def _add(self, edges: DataFrame, mode: str) -> None:
        both = undirected(edges)
        write_buckets(both, f"{self.path}/adjacency", "entity", self.buckets, mode, distinct=True)
        write_buckets(both.groupBy("entity").agg(F.count("*").alias("degree")), f"{self.path}/degrees", "entity", self.buckets, mode)
        write_buckets(both.select("chunk_id", "entity"), f"{self.path}/ends", "chunk_id", self.buckets, mode, distinct=True)


def store_graph(edges: DataFrame, path: str, buckets: int | None = None) -> StoredGraph:
    """Store edges; by default in a bucket for each BUCKET_ROWS ends."""
    edges = scratch_table(edges.select("source_entity_id", "target_entity_id", "source_chunk_id"), "added-edges")
    buckets = buckets or max(1, -(-2 * edges.count() // BUCKET_ROWS))
    graph = StoredGraph(edges.sparkSession, path, buckets)
    graph._add(edges, "error")
    _write_meta(edges.sparkSession, path, buckets)
    return graph


def open_graph(spark: SparkSession, path: str) -> StoredGraph:
    return StoredGraph(spark, path, _buckets(spark, path))


@dataclass(frozen=True)
class StoredTexts:
    """Chunks by chunk and papers by paper."""

    spark: SparkSession
    path: str
    buckets: int

    def chunks(self) -> DataFrame:
        return open_buckets(self.spark, f"{self.path}/chunks", "chunk_id", self.buckets)

    def papers(self) -> DataFrame:
        return open_buckets(self.spark, f"{self.path}/papers", "paper_id", self.buckets)


def store_texts(chunks: DataFrame, papers: DataFrame, path: str, buckets: int | None = None) -> StoredTexts:
    """Store chunks (chunk_id, paper_id, text and more) and papers (paper_id and more); by default in a bucket for each BUCKET_ROWS chunks, or BUCKET_BYTES of their texts."""
    if not buckets:
        n, size = chunks.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        buckets = max(1, -(-n // BUCKET_ROWS), -(-size // BUCKET_BYTES))
    write_buckets(chunks, f"{path}/chunks", "chunk_id", buckets)
    write_buckets(papers, f"{path}/papers", "paper_id", buckets)
    _write_meta(chunks.sparkSession, path, buckets)
    return StoredTexts(chunks.sparkSession, path, buckets)


def open_texts(spark: SparkSession, path: str) -> StoredTexts:
    return StoredTexts(spark, path, _buckets(spark, path))

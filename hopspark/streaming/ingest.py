"""Incremental ingestion: new documents become chunks, upserted batch by batch.

The query's checkpoint remembers which files were read; a batch that is run again after
a failure replaces its own output, as chunk ids depend on content position alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from hopspark.plans.ingest import ingest


def stream_chunks(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "paper_id string, abstract string, body string") -> StreamingQuery:
    """Process what is in ``source`` (Parquet of papers) and not yet done, then stop.

    Each micro-batch goes to a folder ``batch=<id>`` of ``target``; overwriting that
    folder makes a repeated batch harmless.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        ingest(batch.dropDuplicates(["paper_id"])).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    papers = spark.readStream.schema(schema).parquet(source)
    return papers.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_chunks(spark: SparkSession, target: str) -> DataFrame:
    """The chunks of ``target``, of several batches' versions of one the newest."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    w = Window.partitionBy("chunk_id").orderBy(F.desc("batch"))
    return spark.read.parquet(target).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "batch")

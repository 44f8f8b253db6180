"""Intermediate tables in the folder that every executor sees."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that one task sorts or groups, where they are dealt by their number.
TASK_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where it is unset, a temporary one takes its place, in local mode only: on a cluster
    no other machine would see it, so there it is an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="hopspark-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/hopspark/{name}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, n_rows: int, *keys: str) -> DataFrame:
    """``df``, of about ``n_rows`` rows, dealt by ``keys`` into partitions of TASK_ROWS; as it is if it fills only one.

    Other shuffles have a number of partitions that doesn't follow the rows, or a size
    in compressed bytes, of which hash tables may take some twenty times as much.
    """
    parts = -(-n_rows // TASK_ROWS)
    return df if parts < 2 else df.repartition(parts, *keys)


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage: what follows sees one fixed set of rows, however often its
    tasks are run again.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

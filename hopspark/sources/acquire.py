"""Acquisition of documents by address: paced, retried, and only of what isn't there yet."""

from __future__ import annotations

import logging
import time
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopspark.operators.models import retried

log = logging.getLogger(__name__)
_STORED = "id string, content binary"


def fetch_url(url: str, timeout: float = 60.0) -> bytes:
    """The bytes behind an address; an answer that isn't a success is an error."""
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        return answer.read()


def stored_documents(spark, path: str) -> DataFrame:
    """(id, content) of the documents at ``path``; empty ones don't count as there."""
    try:
        rows = spark.read.schema(_STORED).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _STORED)
    return rows.where(F.length("content") > 0)


def download(items: DataFrame, path: str, fetch: Callable[[str], bytes] = fetch_url, clients: int = 4, pause: float = 1.0, attempts: int = 3, first_wait: float = 2.0, longest_wait: float = 10.0) -> DataFrame:
    """(id, content) of those ``items`` (id, url) that could be fetched, now or by an earlier call.

    Documents are kept in the Parquet table at ``path``; what is there isn't fetched
    again.  At most ``clients`` tasks fetch at a time, each waiting ``pause`` seconds
    before every fetch; a failed one is tried again after waits that double from
    ``first_wait`` to ``longest_wait``.  What fails every time is logged and left out, and
    the next call tries it again.  Items without id or url are left out; of several with
    one id the smallest url counts.
    """
    spark = items.sparkSession
    wanted = items.select(F.col("id").cast("string").alias("id"), "url").where("id IS NOT NULL AND url IS NOT NULL").groupBy("id").agg(F.min("url").alias("url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, url in zip(batch["id"].to_pylist(), batch["url"].to_pylist(), strict=True):
                time.sleep(pause)
                content = retried(fetch, url, attempts, first_wait, longest_wait)
                if content is None:
                    log.warning("could not fetch %s", key)
                else:
                    yield pa.RecordBatch.from_pylist([{"id": key, "content": content}], pa.schema([("id", pa.string()), ("content", pa.binary())]))

    missing = wanted.join(stored_documents(spark, path).select("id"), "id", "left_anti")
    missing.repartition(clients, "id").mapInArrow(run, _STORED).write.mode("append").parquet(path)
    # calls side by side may have fetched the same
    return stored_documents(spark, path).join(wanted.select("id"), "id", "left_semi").dropDuplicates(["id"])

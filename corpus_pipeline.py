"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes each
result as Parquet to the shared folder and reads it again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hopspark.llm.bpe import bpe_round_trip
from hopspark.llm.common import scratch_table, table
from hopspark.llm.decontamination import decontaminate
from hopspark.llm.quality_rules import keep_good
from hopspark.llm.queries import MULTI_RANKS
from hopspark.llm.secret_links import redact
from hopspark.llm.simhash import one_of_each

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return keep_good(docs.select(*COLUMNS))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, its smallest row by doc_id (null last) and text hash.

    Of rows that share a doc_id, or have none, each counts in the component of its own
    text, so none is lost.
    """
    return one_of_each(docs.select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, credentials in their texts blotted out."""
    return redact(docs.select(*COLUMNS), count="n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their digest and that of what they decode to."""
    return bpe_round_trip(docs, MULTI_RANKS, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality rules", drop_bad),
    ("simhash near-dedup", keep_one_of_each_group),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", redact_secrets),
    ("byte-level bpe", encode),
]

#: Hashes of shingles and merges by rank have no counterpart in SQL; tests/llm compares
#: run() with a restatement in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch_table(docs, "stage")
    return docs

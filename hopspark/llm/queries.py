"""The queries of this package, by name; each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hopspark.llm.alignment import align_tokenizers
from hopspark.llm.bpe import bpe_round_trip
from hopspark.llm.common import table
from hopspark.llm.cotraining import score_documents
from hopspark.llm.decontamination import DECONTAMINATION_SQL, contaminations
from hopspark.llm.licences import LICENCE_SQL, licence_matches
from hopspark.llm.mixing import mix_sources
from hopspark.llm.quality_rules import QUALITY_SQL, quality_rules
from hopspark.llm.secret_links import secret_scan
from hopspark.llm.simhash import near_duplicates
from hopspark.llm.sstable import token_shards
from hopspark.llm.token_counts import token_counts
from hopspark.llm.warc import archive_pages

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash", "hamming")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op4_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(table(spark, sf_dir, "documents"), WORD_BPE)


def op5_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), BYTE_BPE)


def op7_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_matches(table(spark, sf_dir, "documents"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), MULTI_RANKS, public_tokenizers.PATTERN)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("dup_ngram_chars")


def op10_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_cotraining,
        op2_benchmark_decontamination,
        op3_secret_scan,
        op4_token_sstable,
        op5_warc_normaliser,
        op6_token_counts,
        op7_licence_rules,
        op8_bpe_round_trip,
        op9_quality_rules,
        op10_simhash_vptree,
        op11_tokenizer_alignment,
        op12_source_mixing,
    )
}

ORACLE_SQL = {
    "op5_warc_normaliser": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest, payload FROM p),
        g AS (SELECT payload, max(page_id) AS first_id FROM d WHERE n >= 1000 GROUP BY payload)
        SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
               CASE WHEN g.first_id <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN g.first_id <> d.page_id THEN g.first_id END AS refers_to
        FROM d LEFT JOIN g ON d.payload = g.payload
    """,
    "op2_benchmark_decontamination": DECONTAMINATION_SQL,
    "op7_licence_rules": LICENCE_SQL,
    "op9_quality_rules": QUALITY_SQL,
}

"""The engine's logical tables, read from the TPC-H-like and corpus test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopspark.functions.text import chunk_texts, first_sentence, short_title, words
from hopspark.sources.scratch import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paper per document; its abstract is its first 50 words."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("d"), "doc_id").alias("paper_id"), short_title(F.col("text")).alias("title"), F.array_join(F.slice(words(F.col("text")), 1, 50), " ").alias("abstract"), "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstract (index 0) and body windows (index j + 1) of each paper."""
    rows = papers(spark, sf_dir).select("paper_id", F.posexplode(F.concat(F.array("abstract"), chunk_texts(F.col("text")))).alias("chunk_index", "text"))
    name = F.when(F.col("chunk_index") == 0, F.lit("#abstract")).otherwise(F.concat(F.lit("#chunk"), F.col("chunk_index") - 1))
    return rows.select(F.concat("paper_id", name).alias("chunk_id"), "paper_id", "chunk_index", "text")


def vec_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk per embedding, five to a paper, with the text of the document of the same number."""
    vecs = table(spark, sf_dir, "embeddings")
    paper = F.concat(F.lit("v"), F.expr("vec_id div 5"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    rows = vecs.select("vec_id", F.concat(paper, F.lit("#chunk"), F.expr("vec_id % 5")).alias("chunk_id"), paper.alias("paper_id"), "embedding")
    return rows.join(docs, "vec_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def vec_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of the papers of :func:`vec_chunks`: that of their first chunk's text."""
    return papers_of(vec_chunks(spark, sf_dir))


def papers_of(chunks: DataFrame) -> DataFrame:
    first = chunks.groupBy("paper_id").agg(F.min_by("text", "vec_id").alias("text"))
    return first.select("paper_id", short_title(F.col("text")).alias("title"))


def vec_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of the vector searches: every embedding whose number is divisible by 20.

    The question's text is the first sentence of the chunk's, its gold answer likewise,
    its gold papers those of its own chunk.
    """
    return questions_of(vec_chunks(spark, sf_dir))


def questions_of(chunks: DataFrame) -> DataFrame:
    rows = chunks.where("vec_id % 20 = 0")
    asked = first_sentence(F.col("text"))
    return rows.select(F.col("vec_id").alias("question_id"), "embedding", asked.alias("question"), asked.alias("gold_answer"), F.array("chunk_id").alias("gold_chunk_ids"))


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and the parts they bought, an edge per line of each order."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    n = lines.count()
    rows = dealt(lines, n, "o_orderkey").join(dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), n, "o_orderkey"), "o_orderkey")
    return rows.select(F.concat(F.lit("c"), "o_custkey").alias("source_entity_id"), F.lit("bought").alias("relation"), F.concat(F.lit("p"), "l_partkey").alias("target_entity_id"), F.concat(F.lit("o"), "o_orderkey", F.lit("#abstract")).alias("source_chunk_id"))


def vec_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two edges per embedding: its paper addresses it as a subtopic, and a keyword shared by eight embeddings in a row relates to it."""
    vecs = table(spark, sf_dir, "embeddings")
    paper, target = F.concat(F.lit("v"), F.expr("vec_id div 5")), F.concat(F.lit("t"), "vec_id")
    edge = lambda source, relation: vecs.select(source.alias("source_entity_id"), F.lit(relation).alias("relation"), target.alias("target_entity_id"), F.concat(paper, F.lit("#abstract")).alias("source_chunk_id"))
    return edge(paper, "addresses_subtopic").unionAll(edge(F.concat(F.lit("k"), F.expr("vec_id div 8")), "related_to"))


def vec_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("t"), "vec_id").alias("entity_id"), F.concat(F.lit("topic "), "vec_id").alias("canonical_name"), "embedding")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as questions and candidates: the first user turn asks, all other turns answer, in order."""
    talk = table(spark, sf_dir, "conversations")
    asked = talk.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"), F.min("turn").alias("asked_at"))
    rows = talk.join(asked, "conv_id").where("turn <> asked_at")
    name = F.concat(F.lit("c"), "conv_id", F.lit("-"), F.expr("turn div 4"), F.lit("#turn"), "turn")
    rows = rows.select(F.col("conv_id").alias("question_id"), "question", name.alias("chunk_id"), "turn", "role", "text")
    return rows

"""Retrieval: vector search, graph expansion, one ranked list per question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopspark.config import DEFAULTS, Settings
from hopspark.functions.text import abstract_of, first_sentence, paper_of
from hopspark.functions.vector import nearest
from hopspark.operators.graph import bridges, neighbors
from hopspark.sources.scratch import scratch_table


def vector_topk(questions: DataFrame, chunks: DataFrame, k: int = 20) -> DataFrame:
    """(question_id, chunk_id, similarity, rank): the k nearest chunks to each question."""
    found = nearest(questions.select(F.col("question_id").alias("query_id"), "embedding"), chunks.select(F.col("chunk_id").alias("item_id"), "embedding"), k)
    return found.select(F.col("query_id").alias("question_id"), F.col("item_id").alias("chunk_id"), "similarity", "rank")


def keep_first(rows: DataFrame, order: list[str], limit: int | None) -> DataFrame:
    """Of each question's chunks the first occurrence by ``order``, renumbered, up to ``limit`` if there is one."""
    once = Window.partitionBy("question_id", "chunk_id").orderBy(*order)
    rank = Window.partitionBy("question_id").orderBy(*order)
    kept = rows.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    kept = kept.withColumn("rank", F.row_number().over(rank)).select("question_id", "chunk_id", "rank")
    return kept if limit is None else kept.where(F.col("rank") <= limit)


def expansions(seeds: DataFrame, edges: DataFrame, entities: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(seed, chunk_id, pos): for each seed its neighbours in order of id, then its bridges by rank."""
    near = neighbors(edges, seeds, settings.max_entity_degree).select("seed", "chunk_id", F.lit(0).alias("kind"), F.lit(0).alias("at"))
    far = bridges(edges, entities, seeds, settings.bridge_relation, settings.bridge_threshold, settings.bridge_top_n, settings.bridge_max)
    every = near.unionByName(far.select("seed", "chunk_id", F.lit(1).alias("kind"), F.col("rank").alias("at")))
    order = Window.partitionBy("seed").orderBy("kind", "at", "chunk_id")
    return every.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= settings.expansions_per_seed).select("seed", "chunk_id", "pos")


def hybrid(questions: DataFrame, chunks: DataFrame, edges: DataFrame, entities: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(question_id, chunk_id, rank): vector seeds, what the graph adds to each, then more vector hits.

    One vector search serves seeds and fill; what it found is written once, as the search for
    bridges reads the seeds more than once.  Expansions are cut to their number before
    chunks that came up earlier are dropped, so repeats use up the budget.
    """
    hits = scratch_table(vector_topk(questions, chunks, settings.final_k * settings.oversample), "hits")
    seeds = hits.where(F.col("rank") <= settings.seed_k).select("question_id", "rank", abstract_of(F.col("chunk_id")).alias("seed"))
    more = expansions(seeds.select(F.col("seed").alias("chunk_id")).distinct(), edges, entities, settings)
    spot = lambda stage, a, b: [F.lit(stage).alias("stage"), F.col(a).alias("at"), (F.col(b) if b else F.lit(0)).alias("pos")]
    first = hits.where(F.col("rank") <= settings.seed_k).select("question_id", "chunk_id", *spot(0, "rank", None))
    graph = seeds.join(more, "seed").select("question_id", "chunk_id", *spot(1, "rank", "pos"))
    fill = hits.select("question_id", "chunk_id", *spot(2, "rank", None))
    return keep_first(first.unionByName(graph).unionByName(fill), ["stage", "at", "pos"], settings.final_k)


def merge_lists(lists: DataFrame, limit: int | None = None) -> DataFrame:
    """(question_id, chunk_id, rank) from (question_id, part, chunk_id, rank): the question's own list is part 0, and stands first."""
    return keep_first(lists.withColumnRenamed("rank", "at"), ["part", "at"], limit)


def diversity_cap(ranked: DataFrame, max_per_paper: int = 2) -> DataFrame:
    """The list with each paper's chunks beyond ``max_per_paper`` moved to its end, order kept within both parts."""
    paper = Window.partitionBy("question_id", paper_of(F.col("chunk_id"))).orderBy("rank")
    late = (F.row_number().over(paper) > max_per_paper).alias("late")
    order = Window.partitionBy("question_id").orderBy("late", "rank")
    return ranked.select("*", late).withColumn("new_rank", F.row_number().over(order)).drop("late", "rank").withColumnRenamed("new_rank", "rank")


def rerank(candidates: DataFrame, score: Column, top_n: int | None = 20, max_per_paper: int | None = 2) -> DataFrame:
    """The ``top_n`` candidates of each question (None: all) by falling ``score`` (ties: as before), then capped per paper.

    ``candidates``: question_id, chunk_id, rank and whatever ``score`` reads.
    """
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "rank")
    taken = candidates if top_n is None else candidates.where(F.col("rank") <= top_n)
    scored = taken.withColumn("score", score).withColumn("new_rank", F.row_number().over(order))
    scored = scored.select("question_id", "chunk_id", "score", F.col("new_rank").alias("rank"))
    return scored if max_per_paper is None else diversity_cap(scored, max_per_paper)


def relevance_gate(scored: DataFrame, least: float) -> DataFrame:
    """Questions whose best score is below ``least`` lose all their candidates."""
    best = F.max("score").over(Window.partitionBy("question_id"))
    return scored.withColumn("_best", best).where(F.col("_best") >= least).drop("_best")


def lookup(ranked: DataFrame, chunks: DataFrame, papers: DataFrame | None = None) -> DataFrame:
    """``ranked`` with each chunk's text, and title where ``papers`` is given; unknown chunks are dropped."""
    out = ranked.join(chunks.select("chunk_id", "paper_id", "text"), "chunk_id")
    return out if papers is None else out.join(papers.select("paper_id", "title"), "paper_id")


def answers_from_top(questions: DataFrame, ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, answer): the first sentence of each question's first chunk, '' without one."""
    top = lookup(ranked.where("rank = 1"), chunks).select("question_id", first_sentence(F.col("text")).alias("answer"))
    return questions.select("question_id").join(top, "question_id", "left").select("question_id", F.coalesce("answer", F.lit("")).alias("answer"))

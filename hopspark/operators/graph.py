"""Entity graph: degrees, hub pruning, neighbouring chunks, similarity bridges.

Edges are directed rows (source_entity_id, relation, target_entity_id, source_chunk_id);
traversal works on both directions.  Every operator handles all seeds in one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopspark.functions.vector import nearest
from hopspark.sources.scratch import scratch_table


def undirected(edges: DataFrame) -> DataFrame:
    """(entity, other, chunk_id): each edge from either end, in one scan; a self-loop comes twice."""
    end = lambda a, b: F.struct(F.col(a).alias("entity"), F.col(b).alias("other"))
    both = F.array(end("source_entity_id", "target_entity_id"), end("target_entity_id", "source_entity_id"))
    return edges.select(F.col("source_chunk_id").alias("chunk_id"), F.explode(both).alias("e")).select("e.entity", "e.other", "chunk_id")


def degrees(edges: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """(entity, degree): edge endpoints of each entity, of those in ``entities`` if given."""
    ends = undirected(edges).select("entity")
    if entities is not None:
        ends = ends.join(entities.select(F.col("entity_id").alias("entity")).distinct(), "entity", "left_semi")
    return ends.groupBy("entity").agg(F.count("*").alias("degree"))


def hubs(edges: DataFrame, max_degree: int = 8) -> DataFrame:
    return degrees(edges).where(F.col("degree") > max_degree)


def neighbors(edges: DataFrame, seeds: DataFrame | None = None, max_degree: int = 8) -> DataFrame:
    """(seed, chunk_id): chunks within one entity hop of each seed chunk, itself excluded.

    Entities of more than ``max_degree`` endpoints are passed over, both among a seed's
    own and among those they lead to; what is left fans out by at most ``max_degree`` per
    step, whatever the size of the graph.  ``seeds`` (chunk_id) restricts the seeds.
    """
    both = undirected(edges)
    return _neighbors(both, degrees(edges), both.select("chunk_id", "entity"), seeds, max_degree)


def stored_neighbors(stored, seeds: DataFrame | None = None, max_degree: int = 8) -> DataFrame:
    """:func:`neighbors` of a :class:`hopspark.sources.stored.StoredGraph`: its tables stay where they lie, seeds and what they reach are dealt to them."""
    return _neighbors(stored.adjacency(), stored.degrees(), stored.ends(), seeds, max_degree)


def _neighbors(both: DataFrame, counted: DataFrame, ends: DataFrame, seeds: DataFrame | None, max_degree: int) -> DataFrame:
    small = counted.where(F.col("degree") <= max_degree).select("entity")
    walk = both.join(small, "entity", "left_semi")
    if seeds is None:
        own = walk.select(F.col("chunk_id").alias("seed"), "entity").distinct()
    else:
        asked = seeds.select("chunk_id").distinct()
        # hubs among these fall away where they meet the walk
        own = ends.join(asked, "chunk_id", "left_semi").select(F.col("chunk_id").alias("seed"), "entity").distinct()
    onward = own.join(walk.select("entity", "other").distinct(), "entity").select("seed", F.col("other").alias("entity"))
    # an inner join with these distinct names: a semi join would be moved below and deal the whole walk out by its other end
    reached = own.unionByName(onward.join(small, "entity")).distinct()
    found = reached.join(walk.select("entity", "chunk_id").distinct(), "entity")
    return found.where("chunk_id <> seed").select("seed", "chunk_id").distinct()


def reach(edges, seeds: DataFrame, hops: int, max_degree: int = 8) -> DataFrame:
    """(seed, chunk_id, hop): chunks within ``hops`` steps of :func:`neighbors` from each seed, with the least number of steps.

    ``edges``: a table of edges or a stored graph; ``seeds``: chunk_id.  Each step goes on
    from what the last one found for the first time, and from nothing else; a seed is
    never reached from itself.
    """
    if hops < 1:
        raise ValueError("hops must be 1 or more")
    found, visited = None, seeds.select(F.col("chunk_id").alias("seed"), "chunk_id").distinct()
    visited = frontier = scratch_table(visited, "frontier")
    for hop in range(1, hops + 1):
        here = frontier.select("chunk_id").distinct()
        step = neighbors(edges, here, max_degree) if isinstance(edges, DataFrame) else stored_neighbors(edges, here, max_degree)
        nexts = step.select(F.col("seed").alias("chunk_id"), F.col("chunk_id").alias("next"))
        fresh = frontier.join(nexts, "chunk_id").select("seed", F.col("next").alias("chunk_id")).distinct()
        frontier = scratch_table(fresh.join(visited, ["seed", "chunk_id"], "left_anti"), "frontier")
        told = frontier.withColumn("hop", F.lit(hop))
        found = told if found is None else found.unionAll(told)
        if frontier.isEmpty():
            break
        visited = visited.unionAll(frontier)
    return found


def neighbors_within(edges: DataFrame, hops: int, max_degree: int = 8) -> DataFrame:
    """:func:`neighbors` taken ``hops`` times: chunks reached through chunks."""
    if hops < 1:
        raise ValueError("hops must be 1 or more")
    one = neighbors(edges, None, max_degree)
    reached = last = one
    for _ in range(hops - 1):
        step = one.select(F.col("seed").alias("chunk_id"), F.col("chunk_id").alias("next"))
        last = last.join(step, "chunk_id").where("next <> seed").select("seed", F.col("next").alias("chunk_id")).distinct()
        reached = reached.unionAll(last).distinct()
    return reached


def subtopics(edges: DataFrame, entities: DataFrame, relation: str) -> DataFrame:
    """(edge_id, chunk_id, embedding): a row per edge of ``relation`` whose target has a vector."""
    of = edges.where(F.col("relation") == relation).select(F.col("source_chunk_id").alias("chunk_id"), F.col("target_entity_id").alias("entity_id"))
    rows = of.join(entities.where("embedding IS NOT NULL").select("entity_id", "embedding"), "entity_id")
    # Edges of one chunk to one target are alike; a number tells them apart.
    copy = Window.partitionBy("chunk_id", "entity_id").orderBy(F.lit(1))
    return rows.withColumn("edge_id", F.struct("chunk_id", "entity_id", F.row_number().over(copy).alias("copy")))


def bridges(edges: DataFrame, entities: DataFrame, seeds: DataFrame | None = None, relation: str = "addresses_subtopic", threshold: float = 0.55, top_n: int = 3, max_results: int = 2) -> DataFrame:
    """(seed, chunk_id, similarity, rank): chunks with a subtopic most like one of the seed's.

    Of each own subtopic vector the ``top_n`` nearest subtopic edges of other chunks count
    (by similarity, then chunk), and of these the ones that reach ``threshold``, in this
    order; a chunk gets its best similarity, a seed its ``max_results`` best chunks.
    """
    rows = subtopics(edges, entities, relation)
    # written once: both sides of the search read it, and each is counted first
    named = scratch_table(rows.select(F.to_json("edge_id").alias("name"), "chunk_id", "embedding"), "subtopics")
    own = named if seeds is None else named.join(seeds.select("chunk_id").distinct(), "chunk_id", "left_semi")
    # Item names sort by chunk first, so that ties go to the smaller chunk.
    found = nearest(
        own.select(F.col("name").alias("query_id"), F.col("chunk_id").alias("group_id"), "embedding"),
        named.select(F.concat_ws("\x01", "chunk_id", "name").alias("item_id"), F.col("chunk_id").alias("group_id"), "embedding"),
        top_n,
        exclude_group=True,
        floor=threshold,
    )
    seed, chunk = F.get_json_object("query_id", "$.chunk_id"), F.split_part("item_id", F.lit("\x01"), F.lit(1))
    best = found.groupBy(seed.alias("seed"), chunk.alias("chunk_id")).agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy("seed").orderBy(F.desc("similarity"), "chunk_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_results)

"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopspark.sources.scratch import scratch_table


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), roots included; a root is its component's smallest node.

    Large-star: each neighbour above a node links to the node's smallest neighbour;
    small-star: each below, and the node, link to the smallest; until the edges no longer
    change.  Each round's edges are written out, so the plan stays short and a lost
    executor costs one round at most.  Minima are aggregated before they are joined back,
    so a node with very many links is one row on that side.
    """

    def ordered(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = scratch_table(edges.select("a", "b"), "links")
    nodes = edges.select(F.col("a").alias("node")).unionAll(edges.select(F.col("b").alias("node"))).distinct()
    now = scratch_table(ordered(edges), "edges")
    before = mark(now)
    while before[0]:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = ordered(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionAll(least.select("a", F.col("low").alias("b")))
        now = scratch_table(ordered(small), "edges")
        after = mark(now)
        if after == before:
            break
        before = after
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))

"""Entity resolution: exact by normalised name, then greedy by similarity to cluster founders."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopspark.functions.text import entity_id, normalize_entity
from hopspark.functions.vector import pairs_above
from hopspark.sources.scratch import scratch_table


#: Undecided pairs that one task goes through.
ONE_TASK = 200_000


def resolve_exact(names: DataFrame, name: str = "name") -> DataFrame:
    """(entity_id, normalized, canonical_name, mentions): one entity per normalised name.

    The canonical name is the smallest spelling; empty names share the entity 'unknown'.
    """
    plain = F.coalesce(F.nullif(normalize_entity(F.col(name)), F.lit("")), F.lit("unknown"))
    rows = names.select(plain.alias("normalized"), F.col(name).alias("spelling"))
    return rows.groupBy("normalized").agg(F.min("spelling").alias("canonical_name"), F.count("*").alias("mentions")).select(entity_id(F.col("normalized")).alias("entity_id"), "normalized", "canonical_name", "mentions")


def resolve_greedy(items: DataFrame, threshold: float = 0.87, founders: DataFrame | None = None) -> DataFrame:
    """(item_id, founder_id): each item joins the most similar founder before it, or founds a cluster.

    ``items``: item_id (arrival order), embedding; ``founders`` (item_id, embedding) exist
    beforehand, must sort before all items, and stay founders.  Items without a vector
    found clusters of their own.  Ties go to the earlier founder.

    Items with one and the same vector follow the first of them, or whom it follows, so
    only first ones can be founders; they alone are paired, however often a vector occurs.
    A first one follows if any earlier neighbour (a pair that reaches the threshold) is a
    founder.  That is settled in waves over all of them at once: in each, those without an
    undecided earlier neighbour are founders, and their later neighbours follow.  Once no
    more than ONE_TASK pairs are undecided, one task goes through them in order, which
    gives the same; up to there no task holds more than joins do, and the number of waves
    is at most the length of the longest chain of neighbours in arrival order in which
    each waits for the one before.
    """
    every = items if founders is None else founders.unionByName(items)
    every = scratch_table(every.withColumn("zero", ~F.exists(F.coalesce("embedding", F.array().cast(dict(every.dtypes)["embedding"])), lambda v: v != 0)), "resolved-items")
    old = None if founders is None else founders.select("item_id")
    alike = every.where("NOT zero")
    # founders of old stay founders, whatever their vectors; of new items the first of each vector may be one
    firsts = (alike if old is None else alike.join(old, "item_id", "left_anti")).groupBy("embedding").agg(F.min("item_id").alias("item_id"))
    if old is not None:
        firsts = firsts.unionByName(alike.join(old, "item_id", "left_semi").select("embedding", "item_id"))
    firsts = scratch_table(firsts, "first-of-vector")
    pairs = scratch_table(pairs_above(firsts.select("item_id", "embedding"), threshold), "pairs")
    waiting = pairs if old is None else pairs.join(old.select(F.col("item_id").alias("b")), "b", "left_anti")
    open_, followers = waiting.select("a", "b"), []
    while n := open_.count():
        if n <= ONE_TASK:
            followers.append(scratch_table(_in_order(open_), "followers"))
            break
        first = open_.select("a").join(open_.select(F.col("b").alias("a")), "a", "left_anti").distinct()
        now = scratch_table(open_.join(first, "a", "left_semi").select(F.col("b").alias("item_id")).distinct(), "followers")
        followers.append(now)
        if len(followers) > 8:  # the plan of the last join stays short however many waves there are
            followers = [scratch_table(_union(followers), "followers")]
        settled = now.unionAll(first.select(F.col("a").alias("item_id")))
        left = open_.join(settled.select(F.col("item_id").alias("a")), "a", "left_anti").join(now.select(F.col("item_id").alias("b")), "b", "left_anti")
        open_ = scratch_table(left.select("a", "b"), "open-pairs")
    founding = firsts if not followers else firsts.join(_union(followers), "item_id", "left_anti")
    # whoever isn't a founder takes the most similar founder before it: a neighbour of its vector, or the first of it
    leads = founding.select(F.col("item_id").alias("lead"))
    near = pairs.select(F.col("a").alias("of"), F.col("b").alias("lead"), "similarity").unionByName(pairs.select(F.col("b").alias("of"), F.col("a").alias("lead"), "similarity")).join(leads, "lead")
    own = founding.select(F.col("item_id").alias("of"), F.col("item_id").alias("lead"), F.lit(1.0).alias("similarity"))
    around = firsts.select(F.col("item_id").alias("of"), "embedding").join(near.unionByName(own), "of").groupBy("embedding").agg(F.collect_list(F.struct("lead", "similarity")).alias("leads"))
    # a vector's founders are few: any two of them are less similar than the threshold, but for those of old
    rest = alike.join(founding.select("item_id"), "item_id", "left_anti").join(around, "embedding")
    before = F.filter("leads", lambda x: x["lead"] < F.col("item_id"))
    best = F.array_min(F.transform(before, lambda x: F.struct((-x["similarity"]).alias("s"), x["lead"].alias("lead"))))["lead"]
    found = rest.select("item_id", best.alias("founder_id"))
    return every.select("item_id").join(found, "item_id", "left").select("item_id", F.coalesce("founder_id", "item_id").alias("founder_id"))


def _in_order(pairs: DataFrame) -> DataFrame:
    """(item_id): those that follow, of a bounded number of pairs (a, b), gone through by b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        followers: dict = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field("b").type
            for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
                if a not in followers:  # settled: every pair that ends in a came before
                    followers[b] = None
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.array(list(followers), kind)], ["item_id"])

    return pairs.select("a", "b").repartition(1).sortWithinPartitions("b").mapInArrow(run, f"item_id {dict(pairs.dtypes)['b']}")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionAll(more)
    return out


def first_seen(names: DataFrame, name: str, order: str) -> DataFrame:
    """The earliest row of each normalised name."""
    w = Window.partitionBy(normalize_entity(F.col(name))).orderBy(order)
    return names.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

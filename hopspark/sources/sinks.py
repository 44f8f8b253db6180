"""Upserts and appends as transformations from (stored, new) to the next state of a table.

``new`` may hold several rows of a key; ``order`` names the column that tells them apart
in time.  Without it they are ordered by their own values, so that the result doesn't
depend on the machine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _one_of_each(new: DataFrame, key: str, order: str | None, last: bool) -> DataFrame:
    """The last (or first) row of each key; null keys count as one."""
    names = [order] if order else [c for c in new.columns if c != key]
    by = [F.desc(c) if last else F.asc(c) for c in names]
    w = Window.partitionBy(key).orderBy(*by)
    return new.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def upsert_papers(stored: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """New rows replace stored ones of the same paper_id; of several the last by ``order`` counts."""
    rows = _one_of_each(new, "paper_id", order, last=True).select(*stored.columns)
    return stored.join(rows, "paper_id", "left_anti").unionByName(rows)


def upsert_chunks(stored: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Of a stored chunk only text and embedding are replaced; new chunks come in whole.

    Of several new rows of a chunk the last by ``order`` gives text and embedding, and the
    first what a chunk that isn't stored yet keeps from then on.
    """
    text = _one_of_each(new, "chunk_id", order, last=True).select("chunk_id", "text", "embedding")
    rest = [c for c in stored.columns if c not in ("chunk_id", "text", "embedding")]
    first = _one_of_each(new, "chunk_id", order, last=False).select("chunk_id", *rest)
    a, b = stored.alias("a"), first.join(text, "chunk_id").alias("b")
    both = a.join(b, F.col("a.chunk_id") == F.col("b.chunk_id"), "full_outer")
    kept = F.col("a.chunk_id").isNotNull()
    replaced = F.col("b.chunk_id").isNotNull()
    pick = lambda c: (F.when(replaced, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")) if c in ("text", "embedding") else F.when(kept, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))).alias(c)
    return both.select(*map(pick, stored.columns))


def insert_entities(stored: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Stored entities stay; of new ones with one id the first by ``order`` comes in."""
    fresh = _one_of_each(new.join(stored, "entity_id", "left_anti"), "entity_id", order, last=False)
    return stored.unionByName(fresh.select(*stored.columns))


def append_edges(stored: DataFrame, new: DataFrame, distinct: bool = False) -> DataFrame:
    """All rows of both; repeats stay unless ``distinct``."""
    out = stored.unionByName(new.select(*stored.columns))
    return out.distinct() if distinct else out


def index_lists(n_chunks: Column) -> Column:
    """Number of cells for an inverted index over so many vectors, as the restated service sets it: a hundredth, from 1 to 100."""
    return F.greatest(F.lit(1), F.least(F.lit(100), F.floor(n_chunks / 100))).cast("long")


def vector_index_lists(n_chunks: int) -> int:
    """:func:`index_lists` of a number."""
    return max(1, min(100, n_chunks // 100))


def balanced_lists(n_chunks: int) -> int:
    """Number of cells that grows with the square root, so that cells and centroids cost alike at any size."""
    return max(1, math.isqrt(n_chunks))

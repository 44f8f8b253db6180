"""Mixing sources to target weights: pivotal rounding of copies in a reduction tree.

A source's documents should be taken ``target / size`` times each.  The whole part is
taken as it is; the fraction is a probability that must become 0 or 1 while the source's
words stay what they are:

1. Two documents with fractional probabilities pass words of probability from one to the
   other until one of them is 0 or 1.  Which of the two ways is drawn so that neither's
   probability changes on average; the sum of words never changes.
2. Documents of a source are dealt into groups by hash.  A fold over each group leaves
   one fractional document at most.  These residuals are dealt and folded again, and so
   on up to one per source, which is drawn by its probability.

So a source ends within one document's words of its target, and each level shuffles a
GROUP-th of the rows of the level below.  Every random number is a hash of the seed, the
level and the document, so reruns agree.  All of it is SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopspark.llm.common import scratch_table

#: Documents that are folded together.
GROUP = 128
#: Rows alike in everything that one row becomes at a time.
ALIKE = 4096
#: Most sources whose statistics are sent to every task; more are joined by key.
BROADCAST_SOURCES = 100_000

#: One word (fixed value of the contract).
WORD = "[^\\x20\\x09-\\x0D]+"


def _source_table(units: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(source, source_size, n, target) of every source, one row each."""
    sums = scratch_table(units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"), F.count("*").alias("n_units")), "sources")
    # places of sources in order: within ranges first, then ranges by their counts
    ranges = sums.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranges = scratch_table(ranges, "source-ranges")
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row per range
    offsets = ranges.groupBy("part").agg(F.count("*").alias("rows")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    weighed = scratch_table(ranges.join(F.broadcast(offsets), "part").select("source", "source_size", "n_docs", "n_units", weight.alias("weight")), "source-weights")
    # shares by weight; whoever stands above its cap is set to it and the rest shared anew, until none is
    limit = F.col("source_size") * F.lit(float(cap))
    total, words = weighed.agg(F.sum("weight"), F.sum("source_size")).first()
    words = float(words or 0)
    share, capped = (words / total if total else 0.0), -1
    while True:
        above = limit < F.col("weight") * F.lit(share)
        n, taken, gone = weighed.where(above).agg(F.count("*"), F.sum(limit), F.sum("weight")).first()
        if n == capped or n == 0 or total - gone <= 0:
            break
        capped, share = n, (words - taken) / (total - gone)
    return weighed.select("source", "source_size", "n_docs", "n_units", F.least(limit, F.col("weight") * F.lit(share)).alias("target"))


def _draw(seed: int, level: int) -> Column:
    """A number in (0, 1) for each document at each level."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), F.lit("draw"), "doc_id", "text_hash", "size"), 11)
    return (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)


#: The fold over a group: ``open`` is the place of the fractional document (-1: none), with
#: its words ``s`` and probability ``p``; ``up`` holds the places that became 1.  For an
#: incoming document i, ``gain`` words may pass from it to the open one, ``loss`` the other
#: way; the first happens with probability loss / (gain + loss).
_FOLD = """
    aggregate(
        transform(items, (x, i) -> named_struct('i', i, 's', CAST(x.size AS DOUBLE), 'p', x.p, 'u', x.u)),
        named_struct('open', -1, 's', CAST(0 AS DOUBLE), 'p', CAST(0 AS DOUBLE), 'up', CAST(array() AS ARRAY<INT>)),
        (acc, x) -> IF(acc.open < 0,
            named_struct('open', x.i, 's', x.s, 'p', x.p, 'up', acc.up),
            transform(
                transform(
                    array(named_struct('gain', least((1 - acc.p) * acc.s, x.p * x.s), 'loss', least(acc.p * acc.s, (1 - x.p) * x.s))),
                    d -> named_struct('fills', (1 - acc.p) * acc.s <= x.p * x.s, 'drains', acc.p * acc.s <= (1 - x.p) * x.s,
                                      'rises', x.u * (d.gain + d.loss) < d.loss, 'gain', d.gain, 'loss', d.loss)),
                d -> CASE
                    WHEN d.rises AND d.fills THEN named_struct('open', x.i, 's', x.s, 'p', greatest(x.p - d.gain / x.s, CAST(0 AS DOUBLE)), 'up', array_append(acc.up, acc.open))
                    WHEN d.rises THEN named_struct('open', acc.open, 's', acc.s, 'p', least(acc.p + d.gain / acc.s, CAST(1 AS DOUBLE)), 'up', acc.up)
                    WHEN d.drains THEN named_struct('open', x.i, 's', x.s, 'p', least(x.p + d.loss / x.s, CAST(1 AS DOUBLE)), 'up', acc.up)
                    ELSE named_struct('open', acc.open, 's', acc.s, 'p', greatest(acc.p - d.loss / acc.s, CAST(0 AS DOUBLE)), 'up', array_append(acc.up, x.i))
                END)[0]))
"""


def _folded(rows: DataFrame, groups: Column, seed: int, level: int) -> DataFrame:
    """``rows`` after one level: ``up`` (0 or 1) for those that are settled; ``p`` stays with those that aren't, and ``up`` is null there."""
    group = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "text_hash", "size"), groups)
    # hashes order a group; documents that tie are alike in all that is returned
    item = F.struct(F.xxhash64(F.lit(seed), "doc_id", "text_hash", "size").alias("h"), "doc_id", "text_hash", "size", "p", _draw(seed, level).alias("u"), "unit")
    dealt = rows.groupBy("source", group.alias("g")).agg(F.array_sort(F.collect_list(item)).alias("items"), F.first("n_units").alias("n_units"))
    # a document that stands at 0 or 1 beside one that is settled as well is settled at the next level or by the last draw
    done = dealt.withColumn("acc", F.expr(_FOLD)).select("source", "n_units", "acc", F.posexplode("items").alias("i", "x"))
    up = F.when(F.col("i") == F.col("acc.open"), F.lit(None)).otherwise(F.array_contains("acc.up", F.col("i")).cast("int"))
    return done.select("source", "n_units", *(F.col(f"x.{c}") for c in ("doc_id", "text_hash", "size", "unit")), F.when(F.col("i") == F.col("acc.open"), F.col("acc.p")).otherwise(F.col("x.p")).alias("p"), up.alias("up"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3, seed: int = 42, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: its words, its source's words and target, and what the mix takes of it.

    Sources by code point, null last, weigh ``weights`` in turn and share all words; a
    target stops at ``cap`` times its source's words, and the excess is shared anew.
    ``taken`` is ``copies`` times ``size``: a document is taken the whole part of
    target / source_size times, and once more if its fraction is rounded up.  Null texts
    have no words; documents without words are taken as often as the whole part says. A
    source without words has a target of 0 and nothing is taken.  Repeated rows and null
    ids are documents like any other; of rows with the same identifier, source and text
    it is settled how many are rounded up, and which is of no matter.  Other columns are
    ignored; an empty table gives an empty one.
    """
    words = F.regexp_count(F.coalesce(docs[text], F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[source].cast("string").alias("source"), words.alias("size"), F.xxhash64(docs[text]).alias("text_hash"))
    # rows that are alike in everything are one unit of n: a repeated row can't make a hot group
    units = scratch_table(rows.groupBy("doc_id", "source", "size", "text_hash").agg(F.count("*").alias("n")), "mix-units")
    sources = scratch_table(_source_table(units, weights, cap), "mix-sources")
    small = sources.count() <= BROADCAST_SOURCES
    known = (F.broadcast(sources) if small else sources).withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(F.col("target") / F.col("source_size"), F.lit(float(cap))))
    base = F.floor("rate")
    # n alike with one fraction: whole documents of n times the fraction are up, one is left with the rest
    whole = F.col("n") * (F.col("rate") - base)
    joined = units.join(known, units["source"].eqNullSafe(known["_source"])).withColumn("rate", rate)
    split = joined.withColumns({"base": base.cast("long"), "ups": F.when(F.col("size") > 0, F.floor(whole)).otherwise(0).cast("long"), "p": whole - F.floor(whole)})
    split = scratch_table(split.select("doc_id", "source", "size", "text_hash", "n", "n_units", "source_size", "target", "base", "ups", "p"), "mix-split")
    rest = split.where("p > 0 AND size > 0").select("source", "n_units", "doc_id", "text_hash", "size", "p", F.struct("n", "ups", "base", "source_size", "target").alias("unit"))
    settled = split.where("NOT (p > 0 AND size > 0)").select("doc_id", "size", F.struct("n", "ups", "base", "source_size", "target").alias("unit"), F.lit(0).alias("up"))
    most = sources.agg(F.max("n_units")).first()[0] or 0
    level, out = 0, [settled]
    while True:
        groups = F.greatest(F.lit(1), F.ceil(F.col("n_units") / F.lit(float(GROUP ** (level + 1))))).cast("long")
        state = scratch_table(_folded(rest, groups, seed, level), "mix-level")
        out.append(state.where("up IS NOT NULL").select("doc_id", "size", "unit", "up"))
        rest = state.where("up IS NULL").drop("up")
        level += 1
        if GROUP**level >= most:
            break
    out.append(rest.select("doc_id", "size", "unit", (_draw(seed, level) < F.col("p")).cast("int").alias("up")))
    settled = out[0]
    for more in out[1:]:
        settled = settled.unionByName(more)
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(unit.n - 1) div {ALIKE}"))).alias("part")
    parts = settled.select("doc_id", "size", "unit", "up", part)
    if (units.agg(F.max("n")).first()[0] or 0) > ALIKE:
        parts = parts.repartition("doc_id", "size", "part")
    first = F.col("part") * ALIKE + 1
    each = parts.select("doc_id", "size", "unit", "up", F.explode(F.sequence(first, F.least(first + ALIKE - 1, F.col("unit.n")))).alias("k"))
    copies = F.col("unit.base") + F.when(F.col("k") <= F.col("unit.ups") + F.col("up"), 1).otherwise(0)
    return each.select("doc_id", "size", F.col("unit.source_size").alias("source_size"), F.col("unit.target").alias("target"), (copies * F.col("size")).cast("long").alias("taken"), copies.cast("long").alias("copies"))

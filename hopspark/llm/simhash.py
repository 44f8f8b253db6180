"""SimHash near-duplicates by vantage-point trees over Hamming distance.

Fingerprints are 64 majority votes of the hashes of a text's word shingles.  Copies fall
into one class first; only distinct fingerprints are searched.

A tree splits the space: at each node a vantage point ``v`` and a radius ``m`` send a
fingerprint ``x`` to the inside (``d(x, v) <= m``) or outside.  By the triangle inequality
two fingerprints within ``r`` of each other can lie on different sides only if the outer
one has ``m < d <= m + r``; those, and no others, are sent to the inside as well.  Every
linked pair thus meets in at least one leaf, and is found there exactly.

Trees are grown on samples, with boundary copies counted, so that the load of leaves is
even.  A leaf that still holds more than twice SHARD_SIZE gets a tree of its own in a
further round, so shards stay bounded whatever the number of fingerprints; nothing is
held by the driver.  In a shard the same splitting goes on in memory down to small
leaves, which are compared in full.  A shard reports a spanning forest of its links,
never all pairs, and the forests are joined to components by rounds of large-star and
small-star steps.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopspark.llm.common import give_back, scratch_table, slices, text_bytes
from hopspark.operators.components import connected

RADIUS = 2
#: Fingerprints aimed at per shard (8 bytes each); twice as many are split again.
SHARD_SIZE = 32768
#: Sample points aimed at per shard, and most in the sample of one tree (one task holds it).
PER_SHARD, SAMPLE = 64, 65536
#: Rounds of splitting: each makes a thousand shards of one, so the last is for corpora beyond any.
MAX_ROUNDS = 3
#: Large-shard identifiers (a long and a count each) up to which they are broadcast.
BROADCAST_SHARDS = 500_000
LEAF = 512
#: A split must bring the work of comparing in full below this share of what it was.
PAYS = 0.9


def fingerprint(data: bytes) -> int:
    """The fingerprint of a text in UTF-8, unsigned; 0 without words."""
    import xxhash

    words = data.lower().split()  # bytes: only A-Z are lowered, only the six ASCII blanks divide
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < 3 else [b" ".join(t) for t in zip(words, words[1:], words[2:], strict=False)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed=42) for s in shingles), "<u8", len(shingles))
    votes = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) for each row; fp has the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.fromiter((fingerprint(x.as_py() or b"") for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), text_bytes(text).alias("data")).mapInArrow(run, "doc_id long, fp long")


def distances(points: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ to)


def split(points: np.ndarray, radius: int) -> tuple[np.uint64, int] | None:
    """A vantage point and radius for ``points``; None if no split pays.

    Of a few points spread over the input, each with every radius, the one under which
    the two sides, replicas included, cost least to compare in full.
    """
    best = None
    for k in range(min(4, len(points))):
        v = points[k * (len(points) - 1) // 3 if len(points) > 3 else k]
        upto = np.cumsum(np.bincount(distances(points, v), minlength=65 + radius)).astype(float)
        inner = upto[radius : 64 + radius]
        outer = len(points) - upto[:64]
        cost = inner**2 + outer**2
        cost[(inner >= len(points)) | (outer <= 0)] = np.inf
        m = int(cost.argmin())
        if cost[m] <= PAYS * len(points) ** 2 and (best is None or cost[m] < best[0]):
            best = (cost[m], v, m)
    return best and best[1:]


def tree(sample: np.ndarray, size: int, radius: int) -> tuple | int:
    """(vantage, radius, inside, outside) down to parts of ``size`` sample points, boundary copies counted; leaves are numbered."""
    count = iter(range(1 << 30))

    def grow(points: np.ndarray) -> tuple | int:
        if len(points) <= size or (cut := split(points, radius)) is None:
            return next(count)
        d = distances(points, cut[0])
        return (*cut, grow(points[d <= cut[1] + radius]), grow(points[d > cut[1]]))

    return grow(sample)


def route(points: np.ndarray, node: tuple | int, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, points there), boundary points in several leaves."""
    if not len(points):
        return
    if isinstance(node, int):
        yield node, points
        return
    v, m, inside, outside = node
    d = distances(points, v)
    yield from route(points[d <= m + radius], inside, radius)
    yield from route(points[d > m], outside, radius)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node of its component under the links (i, j)."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        low = np.minimum(a, b)
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def leaf_links(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of linked pairs reduced to a spanning forest; points are sorted and distinct.

    Compared in full, tile by tile; a large set that no sphere divides with profit (all
    points close together) has its neighbourhoods looked up instead where the radius is
    at most 2, so that the work stays in proportion to its size.
    """
    n = len(points)
    low = np.arange(n)
    if n <= 8192 or radius > 2:
        for a in range(0, n, 512):
            for b in range(a, n, 8192):
                i, j = np.nonzero(np.bitwise_count(points[a : a + 512, None] ^ points[None, b : b + 8192]) <= radius)
                low = forest(n, np.concatenate([np.arange(n), i + a]), np.concatenate([low, j + b]))
    else:
        one = np.uint64(1) << np.arange(64, dtype=np.uint64)
        masks = one if radius == 1 else np.concatenate([one, *(one[k] ^ one[k + 1 :] for k in range(63))])
        for mask in masks if radius else ():
            to = points ^ mask
            at = np.minimum(np.searchsorted(points, to), n - 1)
            hit = np.flatnonzero((points[at] == to) & (to > points))
            if len(hit):
                low = forest(n, np.concatenate([np.arange(n), hit]), np.concatenate([low, at[hit]]))
    member = np.flatnonzero(low != np.arange(n))
    return member, low[member]


def links(points: np.ndarray, radius: int = RADIUS, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """(member, root): a forest over ``points`` whose components are those of all pairs within ``radius``."""
    points = np.unique(points)
    members, roots = [], []
    stack = [points]
    while stack:
        part = stack.pop()
        if len(part) > leaf and (cut := split(part, radius)) is not None:
            d = distances(part, cut[0])
            stack += [part[d <= cut[1] + radius], part[d > cut[1]]]
        elif len(part) > 1:
            a, b = leaf_links(part, radius)
            members.append(part[a])
            roots.append(part[b])
    if not members:
        return points[:0], points[:0]
    a, b = np.searchsorted(points, np.concatenate(members)), np.searchsorted(points, np.concatenate(roots))
    low = forest(len(points), a, b)
    member = np.flatnonzero(low != np.arange(len(points)))
    return points[member], points[low[member]]


def shards_of(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(shard, fp): every fingerprint of ``classes.fp`` in each shard that it must meet others in.

    Each round grows a tree for every shard of more than twice SHARD_SIZE, from a hashed
    sample of its rows, and deals its rows by that tree.  A shard's rows are dealt in
    parts, each led by a copy of the tree, so no task holds more than a batch and a tree.
    A shard in which no split pays (fingerprints that differ in a few bits only) stays
    whole: MAX_ROUNDS ends the attempts.
    """
    dealt = classes.select(F.col("fp").bitwiseAND(F.lit(0)).alias("shard"), "fp")  # a literal would make the joins below nested loops

    def grow(sample: pd.DataFrame) -> pd.DataFrame:
        points = np.unique(sample["fp"].to_numpy(np.int64)).view(np.uint64)
        return pd.DataFrame({"shard": [sample["shard"].iloc[0]], "tree": [pickle.dumps(tree(points, PER_SHARD, radius))]})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, top = 0, 0
        for batch in batches:
            trees, points = batch.column("tree"), batch.column("fp").fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
            marks = np.flatnonzero(trees.is_valid().to_numpy(zero_copy_only=False)).tolist()
            for a, b in zip([-1, *marks], [*marks, len(points)], strict=True):
                if a >= 0:
                    shard, top = batch.column("shard")[a].as_py(), pickle.loads(trees[a].as_py())
                for leaf, part in route(points[a + 1 : b], top, radius):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), shard << 16 | leaf, np.int64)), pa.array(part.view(np.int64))], ["shard", "fp"])
        give_back()

    for _ in range(MAX_ROUNDS):
        big = dealt.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > 2 * SHARD_SIZE)
        big = scratch_table(big, "large-shards")
        if not (shards := big.count()):
            break
        own = dealt.join(F.broadcast(big) if shards <= BROADCAST_SHARDS else big, "shard")
        wanted = F.least(F.lit(SAMPLE), F.ceil(F.col("n") / SHARD_SIZE) * PER_SHARD)
        drawn = F.pmod(F.xxhash64(F.col("fp"), F.lit(7)), F.lit(1 << 40)) < F.lit(1 << 40) * (wanted / F.col("n"))
        trees = own.where(drawn).select("shard", "fp").groupBy("shard").applyInPandas(grow, "shard long, tree binary")
        parts = F.ceil(F.col("n") / (8 * SHARD_SIZE)).cast("int")
        leads = trees.join(big, "shard").select("shard", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "tree", F.lit(None).cast("long").alias("fp"))
        rows = own.select("shard", F.pmod(F.xxhash64("fp"), parts).cast("int").alias("part"), F.lit(None).cast("binary").alias("tree"), "fp")
        n_tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        led = rows.unionByName(leads).repartition(n_tasks, "shard", "part").sortWithinPartitions("shard", "part", F.col("tree").isNull())
        rest = dealt.join(F.broadcast(big.select("shard")) if shards <= BROADCAST_SHARDS else big.select("shard"), "shard", "left_anti")
        dealt = scratch_table(led.select("shard", "tree", "fp").mapInArrow(deal, "shard long, fp long").unionByName(rest), "shards")
    return dealt


def links_of(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): forests of links between the distinct fingerprints in ``classes.fp``."""

    def search(group: pd.DataFrame) -> pd.DataFrame:
        a, b = links(group["fp"].to_numpy(np.int64).view(np.uint64), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return shards_of(classes, radius).groupBy("shard").applyInPandas(search, "a long, b long")


#: Bytes of a bitmap of chosen rows, as Spark makes them, and of all that are broadcast.
BITMAP_BYTES, BROADCAST_BITMAPS = 4096, 64_000_000


def _rooted(prints: DataFrame, first: Column, radius: int) -> DataFrame:
    """(fp, first, root): each distinct fingerprint, ``first`` over its rows, and its component's root."""
    classes = scratch_table(prints.groupBy("fp").agg(first.alias("first")), "classes")
    roots = connected(links_of(classes, radius))
    return classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints that differ in ``radius`` bits or fewer are linked; ``component_id`` is
    the smallest doc_id of the component.  Null and empty texts have fingerprint zero and
    are linked like any other.  Rows of null doc_id take part; a component of such rows
    alone has a null component_id.  Repeated rows give a row each; an empty table gives
    an empty one.
    """
    prints = scratch_table(fingerprints(docs, doc_id, text), "fingerprints")
    rooted = _rooted(prints, F.min("doc_id"), radius)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    found = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs``, all columns, for each component of :func:`near_duplicates`.

    The row is the smallest by doc_id (null last), then text hash; of rows alike in both
    any one.  Components are told apart by their root fingerprint, so rows that share a
    doc_id, or have none, count in the component of their own text.

    Rows are written once, with their fingerprint and a number of their own.  All that
    follows reads fingerprints and numbers; whole rows come in again at the end, where
    each looks its number up in a bitmap of the chosen ones, and texts aren't shuffled.
    Beyond BROADCAST_BITMAPS bytes of bitmaps, which hold some hundred million rows, rows
    meet the chosen numbers in a join that neither sorts nor aggregates texts, and in
    which no key has more than one row.
    """
    names = docs.columns
    flat = docs.select(*(docs[c].alias(f"c{k}") for k, c in enumerate(names)))  # no clash with names of our own
    at = names.index(text)

    @F.arrow_udf("long")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            yield pa.array(np.fromiter((fingerprint((x.as_py() or "").encode()) for x in part), np.uint64, len(part)).view(np.int64))
        give_back()

    # only texts go to the worker and only fingerprints come back; whole rows stay in the JVM
    rows = scratch_table(flat.select("*", of(f"c{at}").alias("fp"), F.monotonically_increasing_id().alias("row")), "rows")
    number = F.col(f"c{names.index(doc_id)}").cast("long")
    key = F.struct(number.isNull().alias("no_id"), number.alias("id"), F.xxhash64(f"c{at}").alias("text_hash"), "row")
    rooted = _rooted(rows.select("fp", key.alias("key")), F.min("key"), radius)
    chosen = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.row")
    own = [F.col(f"c{k}").alias(c) for k, c in enumerate(names)]
    slot, bit = F.bitmap_bucket_number("row").alias("slot"), F.bitmap_bit_position("row")
    bitmaps = scratch_table(chosen.groupBy(slot).agg(F.bitmap_construct_agg(bit).alias("bitmap")), "chosen")
    if bitmaps.count() * BITMAP_BYTES > BROADCAST_BITMAPS:
        return rows.join(chosen.hint("shuffle_hash"), "row", "left_semi").select(*own)
    byte = F.conv(F.hex(F.expr("substring(bitmap, CAST(bitmap_bit_position(row) div 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    kept = F.getbit(byte, (bit % 8).cast("int")) == 1
    return rows.withColumn("slot", slot).join(F.broadcast(bitmaps), "slot").where(kept).select(*own)

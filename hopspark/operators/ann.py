"""A stored inverted-file index over vectors: rows in partitions by cell, searched a few cells per query.

A path holds four Parquet tables:

    tops     top, centroid: the coarse centroids, about the square root of the number of cells
    cells    top, cell, centroid: each coarse centroid's own cells
    rows     item_id, embedding, partitioned by top and cell
    stats    cell, n_rows: rows of each cell when they were last counted

Coarse centroids are fitted on at most SAMPLE vectors, the only ones the driver holds; the
cells of each on at most TOP_SAMPLE of those nearest to it, one task a coarse centroid.
Samples are chosen by a hash of the identifier.  Every row is indexed, in its nearest
cells of its nearest coarse centroids, so that a neighbour just across a border is found
as well.  No task and no driver holds the centroids of all cells: where rows or queries
meet cells, both come as one stream sorted by coarse centroid, the cells first.

A search reads the partitions of the cells that its queries look into and no others.
Queries of up to MAX_BROADCAST_BYTES go to the tasks that read them, so that stored rows
aren't shuffled; more queries meet the rows by cell.

Recall follows from the vectors.  The test vectors have no clusters, so that good recall
takes many cells; vectors of an encoder lie in clusters and need fewer.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from hopspark.functions import vector
from hopspark.functions.vector import Best, _unit
from hopspark.sources.scratch import scratch_table
from hopspark.sources.sinks import balanced_lists

#: Vectors on which coarse centroids are fitted, and the cells of one of these.
SAMPLE, TOP_SAMPLE = 20_000, 16_384
#: Sampled vectors for each cell.
PER_CELL = 64
#: Coarse centroids that hold each row, and cells of each.
TOPS, CELLS = 2, 2
#: Shares of the coarse centroids, and of the cells of each, that a search looks into.
PROBED_TOPS, PROBED_CELLS = 0.6, 0.6
#: Rows that one task assigns or holds together.
CELL_ROWS = 100_000
#: Most cells that are named in the plan of a search; more are found by a join with them.
NAMED_CELLS = 10_000


def closest(vectors: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` most similar centroids of each vector, best first, ties to the smaller place."""
    n = min(n, len(centroids))
    out = np.empty((len(vectors), n), np.int64)
    step = max(1, 4_000_000 // max(1, len(centroids)))
    for a in range(0, len(vectors), step):
        sims = vectors[a : a + step] @ centroids.T
        if n == 1:
            out[a : a + step, 0] = sims.argmax(1)
        else:
            part = np.sort(np.argpartition(-sims, n - 1, axis=1)[:, :n], axis=1)
            order = np.argsort(-np.take_along_axis(sims, part, 1), axis=1, kind="stable")
            out[a : a + step] = np.take_along_axis(part, order, 1)
    return out


def fit(sample: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids by spherical k-means, seeded by every n-th sample; empty cells keep their centroid."""
    centroids = sample[:: max(1, len(sample) // lists)][:lists].copy()
    for _ in range(rounds):
        cell = closest(sample, centroids, 1)[:, 0]
        order = np.argsort(cell, kind="stable")
        present, first = np.unique(cell[order], return_index=True)
        sums = np.add.reduceat(sample[order], first) if len(first) else sample[:0]
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        filled = size[:, 0] > 0
        centroids[present[filled]] = sums[filled] / size[filled]
    return centroids


@dataclass(frozen=True)
class Index:
    """A stored index and the types of what it holds."""

    spark: SparkSession
    path: str
    id_type: str
    embedding_type: str

    def tops(self) -> np.ndarray:
        """The coarse centroids in order."""
        rows = self.spark.read.schema("top int, centroid array<double>").parquet(f"{self.path}/tops").orderBy("top").toArrow()
        return _unit(rows["centroid"].combine_chunks())

    def cells(self) -> DataFrame:
        return self.spark.read.schema("top int, cell int, centroid array<double>").parquet(f"{self.path}/cells")

    def rows(self) -> DataFrame:
        """Every row as often as cells hold it."""
        return self.spark.read.schema(f"item_id {self.id_type}, embedding {self.embedding_type}, top int, cell int").parquet(f"{self.path}/rows")

    def stats(self) -> DataFrame:
        return self.spark.read.schema("cell int, n_rows long").parquet(f"{self.path}/stats")


def open_index(spark: SparkSession, path: str) -> Index:
    """An index that was built before."""
    kinds = dict(spark.read.parquet(f"{path}/rows").dtypes)
    return Index(spark, path, kinds["item_id"], kinds["embedding"])


def _places(rows: DataFrame, tops: np.ndarray, n: int, salts: np.ndarray, key: str) -> DataFrame:
    """``rows`` (``key``, embedding) once for each of its ``n`` nearest coarse centroids: with top, and a salt of its own for hot ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 4096):
                batch = whole.slice(a, 4096)
                near = closest(_unit(batch["embedding"]), tops, n)
                at = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                hashed = np.array([zlib.crc32(repr(x).encode()) for x in batch[key].to_pylist()], np.int64)
                top = near.ravel()
                salt = np.repeat(hashed, near.shape[1]) % salts[top]
                yield pa.RecordBatch.from_arrays([batch[key].take(at), batch["embedding"].take(at), pa.array(top.astype(np.int32)), pa.array(salt.astype(np.int32))], [key, "embedding", "top", "salt"])

    kinds = dict(rows.dtypes)
    return rows.select(key, "embedding").mapInArrow(run, f"{key} {kinds[key]}, embedding {kinds['embedding']}, top int, salt int")


def _cells_of(placed: DataFrame, index: Index, salts: np.ndarray, n: int, key: str) -> DataFrame:
    """(``key``, embedding, top, cell): each row of ``placed`` once for each of its ``n`` nearest cells of its coarse centroid."""
    kinds = dict(placed.dtypes)
    spread = index.spark.createDataFrame([(k, int(s)) for k, s in enumerate(salts)], "top int, salts int")
    # a row for each coarse centroid, of which there are about as many as the fourth root of all rows
    cells = index.cells().join(F.broadcast(spread), "top").select(F.lit(None).cast(kinds[key]).alias(key), F.lit(None).cast(kinds["embedding"]).alias("embedding"), "top", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "cell", "centroid")
    rows = placed.withColumns({"cell": F.lit(None).cast("int"), "centroid": F.lit(None).cast("array<double>")})
    stream = cells.unionByName(rows).repartition("top", "salt").sortWithinPartitions("top", "salt", F.col("cell").asc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, names, held, known = None, [], [], None
        for batch in batches:
            at = np.stack([batch["top"].to_numpy(), batch["salt"].to_numpy()])
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(at) != 0).any(axis=0)) + 1, [batch.num_rows]]).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if place != (place := tuple(at[:, a].tolist())):
                    names, held, known = [], [], None
                part = batch.slice(a, b - a)
                own = part.num_rows - part["cell"].null_count
                if own:
                    names.append(part["cell"].slice(0, own).to_numpy())
                    held.append(_unit(part["centroid"].slice(0, own)))
                part = part.slice(own)
                if not part.num_rows:
                    continue
                if known is None:
                    known = np.concatenate(names), np.concatenate(held)
                near = closest(_unit(part["embedding"]), known[1], n)
                again = pa.array(np.repeat(np.arange(part.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([part[key].take(again), part["embedding"].take(again), part["top"].take(again), pa.array(known[0][near.ravel()].astype(np.int32))], [key, "embedding", "top", "cell"])

    return stream.mapInArrow(run, f"{key} {kinds[key]}, embedding {kinds['embedding']}, top int, cell int")


def build(corpus: DataFrame, path: str, lists: int | None = None) -> Index:
    """Store an index of all rows of ``corpus`` (item_id, embedding) that have a vector, in about ``lists`` cells.

    By default these are as many as the square root of the rows.
    """
    spark, rows = corpus.sparkSession, corpus.where("embedding IS NOT NULL").select("item_id", "embedding")
    kinds, n = dict(rows.dtypes), rows.count()
    lists = lists or balanced_lists(n)
    side = max(1, isqrt(lists))
    per = ceil(lists / side)
    chance = lambda seed: F.xxhash64("item_id", F.lit(seed))
    taken = rows.orderBy(chance(3), "item_id").limit(SAMPLE).toArrow()
    sample = _unit(taken["embedding"].combine_chunks()) if len(taken) else np.zeros((0, 1))
    tops = fit(sample, side) if len(sample) else np.zeros((0, 1))
    table = lambda data, schema: spark.createDataFrame(data, schema).coalesce(1)
    table([(k, c.tolist()) for k, c in enumerate(tops)], "top int, centroid array<double>").write.parquet(f"{path}/tops")
    index = Index(spark, path, kinds["item_id"], kinds["embedding"])
    # the rest of the sample: PER_CELL rows for each cell, dealt by coarse centroid
    share = min(1.0, PER_CELL * lists / max(1, n))
    some = rows.where(F.pmod(chance(5), F.lit(1 << 20)) < ceil(share * (1 << 20)))
    placed = _places(some, tops, 1, np.ones(max(1, len(tops)), np.int64), "item_id")
    nth = F.row_number().over(Window.partitionBy("top").orderBy(chance(7), "item_id"))
    placed = placed.withColumn("nth", nth).where(F.col("nth") <= TOP_SAMPLE)

    def fit_cells(key: tuple, mine: pa.Table) -> pa.Table:
        top = key[0].as_py()
        found = fit(_unit(mine.sort_by("nth")["embedding"].combine_chunks()), per)
        cells = np.arange(len(found)) + top * per
        return pa.table([pa.array(np.full(len(found), top, np.int32)), pa.array(cells.astype(np.int32)), pa.array(found.tolist(), pa.list_(pa.float64()))], ["top", "cell", "centroid"])

    fitted = placed.groupBy("top").applyInArrow(fit_cells, "top int, cell int, centroid array<double>")
    # a coarse centroid that no sampled row is nearest to has itself for a cell
    plain = spark.read.schema("top int, centroid array<double>").parquet(f"{path}/tops").join(placed.select("top").distinct(), "top", "left_anti")
    fitted.unionByName(plain.select("top", (F.col("top") * per).cast("int").alias("cell"), "centroid")).write.parquet(f"{path}/cells")
    shares = np.bincount(closest(sample, tops, 1)[:, 0], minlength=len(tops)) / max(1, len(sample)) if len(tops) else np.ones(1)
    append(index, rows, n, shares)
    return index


def append(index: Index, more: DataFrame, n: int | None = None, shares: np.ndarray | None = None) -> None:
    """Add rows (item_id, embedding) to the cells that are nearest to them, and count anew.

    Centroids stay as they are.  ``n`` and ``shares`` of coarse centroids, where they are
    known, say how many tasks each is dealt over.
    """
    rows = more.where("embedding IS NOT NULL").select(F.col("item_id").cast(index.id_type), F.col("embedding").cast(index.embedding_type))
    tops = index.tops()
    n = rows.count() if n is None else n
    shares = np.full(max(1, len(tops)), 1 / max(1, len(tops))) if shares is None else shares
    salts = np.maximum(1, np.ceil(TOPS * n * shares / CELL_ROWS)).astype(np.int64)
    kept = _cells_of(_places(rows, tops, TOPS, salts, "item_id"), index, salts, CELLS, "item_id")
    kept.write.mode("append").partitionBy("top", "cell").parquet(f"{index.path}/rows")
    index.rows().groupBy("cell").agg(F.count("*").alias("n_rows")).write.mode("overwrite").parquet(f"{index.path}/stats")


def search(queries: DataFrame, index: Index, k: int, tops: float = PROBED_TOPS, cells: float = PROBED_CELLS) -> DataFrame:
    """(query_id, item_id, similarity, rank): the k best rows in the cells that each query (query_id, embedding) looks into.

    These are the nearest ``cells`` of all cells of the nearest ``tops`` of all coarse
    centroids, as shares; 1 and 1 is exact.
    """
    rows = queries.where("embedding IS NOT NULL").select("query_id", "embedding")
    coarse = index.tops()
    per = index.cells().groupBy("top").count().agg(F.max("count")).first()[0] or 1
    salts = np.ones(max(1, len(coarse)), np.int64)
    aimed = _cells_of(_places(rows, coarse, ceil(tops * len(coarse)), salts, "query_id"), index, salts, ceil(cells * per), "query_id")
    aimed = scratch_table(aimed, "probes")
    asked = aimed.select("cell").distinct()
    if asked.count() <= NAMED_CELLS:
        stored = index.rows().where(F.col("cell").isin([r.cell for r in asked.collect()]))
    else:
        stored = index.rows().join(asked, "cell", "left_semi")
    n, dims = aimed.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    met = _held_search if vector.held_bytes(n, dims, k) <= vector.MAX_BROADCAST_BYTES else _dealt_search
    found = met(aimed, stored, index, k)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id")
    found = found.groupBy("query_id", "item_id").agg(F.max("similarity").alias("similarity"))  # a row comes from each of its cells
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _held_search(aimed: DataFrame, stored: DataFrame, index: Index, k: int) -> DataFrame:
    """Each task holds the queries and reads stored rows as they lie; it sends back the best rows of each query."""
    held = aimed.select("query_id", "embedding", "cell").toArrow()
    id_type, kind = to_arrow_type(index.rows().schema["item_id"].dataType), dict(aimed.dtypes)["query_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = held["cell"].to_numpy()
        order = np.argsort(cells, kind="stable")
        names, first = np.unique(cells[order], return_index=True)
        asking = dict(zip(names.tolist(), np.split(order, first[1:]), strict=True))
        # a query is one entry for each cell it looks into; a row is in few cells, so as many rows more are kept
        best = Best(_unit(held["embedding"].combine_chunks()), k)
        for batch in batches:
            at = batch["cell"].to_numpy()
            order = np.argsort(at, kind="stable")
            names, first = np.unique(at[order], return_index=True)
            places, vectors = best.learn(batch["item_id"]), _unit(batch["embedding"])
            for cell, mine in zip(names.tolist(), np.split(order, first[1:]), strict=True):
                if cell in asking:
                    best.meet(vectors[mine], places[mine], of=asking[cell])
        yield from best.rows(held["query_id"].combine_chunks(), id_type)

    return stored.select("item_id", "embedding", "cell").mapInArrow(run, f"query_id {kind}, item_id {index.id_type}, similarity double")


def _dealt_search(aimed: DataFrame, stored: DataFrame, index: Index, k: int) -> DataFrame:
    """Queries and rows meet by cell, a cell of more than CELL_ROWS in several parts."""
    parts = index.stats().select("cell", F.ceil(F.col("n_rows") / CELL_ROWS).cast("int").alias("parts"))
    left = aimed.select("query_id", F.col("embedding").alias("q"), "cell").join(parts, "cell").select("query_id", "q", F.col("cell").alias("at"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = stored.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("item_id"), F.col("parts")).cast("int"))
    types = [to_arrow_type(aimed.schema["query_id"].dataType), to_arrow_type(stored.schema["item_id"].dataType), pa.float64()]
    empty = pa.table([pa.array([], t) for t in types], ["query_id", "item_id", "similarity"])

    def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not len(mine) or not len(theirs):
            return empty
        best = Best(_unit(mine["q"].combine_chunks()), k)
        best.meet(_unit(theirs["embedding"].combine_chunks()), best.learn(theirs["item_id"].combine_chunks()))
        return pa.Table.from_batches([*empty.to_batches(), *best.rows(mine["query_id"].combine_chunks(), types[1])], empty.schema)

    schema = f"query_id {dict(aimed.dtypes)['query_id']}, item_id {index.id_type}, similarity double"
    return left.groupBy("at", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(meet, schema)

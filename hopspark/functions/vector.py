"""Vectors: expressions for a few pairs, blocked numpy for nearest neighbours.

Similarities are rounded to DIGITS decimals before they are compared, so that ties are
broken by identifier and not by the last bit of a sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

DIGITS = 9
#: Bytes of query vectors and of what is found for them up to which all are sent to every
#: task; beyond it the two sides are dealt in blocks of so many bytes that meet pairwise.
MAX_BROADCAST_BYTES = 64_000_000
#: Rows of a tile, and of the first ones: until a query has its rows, none can be passed over.
_BLOCK, _FIRST = 8192, 512
#: Pairs of a tile up to which each is worked out by itself, and how many of them at once.
_SCREENED, _AT_ONCE = 16_384, 4_096
#: Vectors of either side that are compared at once, and pairs that leave a task at once.
_TILE, _PAIRS = 1024, 65_536


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def normalize(a: Column) -> Column:
    """The vector at unit length; a zero vector as it is."""
    # the length is an element of its own, so that it is worked out once and not for every place
    by = lambda size: F.transform(a, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double")))
    return F.get(F.transform(F.array(norm(a)), by), F.lit(0))


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """The offline embedder: unit vector of word counts, words dealt into ``dims`` places by their MD5.

    Words are distinct runs of ASCII letters and digits in lower case; a text without any
    (null included) gets the zero vector.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    places = F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(dims)))
    counts = lambda held: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.size(F.filter(held, lambda p: p == k)).cast("double"))
    return F.get(F.transform(F.array(F.get(F.transform(F.array(places), counts), F.lit(0))), normalize), F.lit(0))


def _unit(vectors: pa.Array) -> np.ndarray:
    flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64)
    m = flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _longest(m: np.ndarray) -> float:
    return float(np.fmax.reduce(np.linalg.norm(m, axis=1), initial=0.0))


class Best:
    """The k best rows by (similarity, id) that each query has met so far.

    However many rows come, and however alike they are, a query takes k similarities and
    k places among the ids that some query holds.
    """

    def __init__(self, queries: np.ndarray | pa.Array, k: int, groups: np.ndarray | None = None, floor: float = -np.inf):
        """``queries``: vectors to be taken as they are, or an Arrow array of those that are brought to unit length as they meet rows; ``floor``: the least similarity that counts."""
        self.queries, self.k, self.groups, self.floor = queries, k, groups, floor
        self.sims = np.full((len(queries), k), -np.inf)
        self.at = np.full((len(queries), k), -1, np.int32)
        self.met = 0
        self.ids: pa.Array | None = None  # in ascending order, as places are

    def learn(self, ids: pa.Array) -> np.ndarray:
        """Take in the ids of further rows, let go of those that no query holds, and give the new ones' places."""
        before = ids.slice(0, 0) if self.ids is None else self.ids
        held = np.zeros(len(before) + 1, bool)
        held[self.at] = True  # an empty place, -1, is the last
        kept = np.flatnonzero(held[:-1])
        every = pa.concat_arrays([before.take(pa.array(kept)), ids])
        order = pc.sort_indices(every).to_numpy()
        place = np.empty(len(every), np.int32)
        place[order] = np.arange(len(every), dtype=np.int32)
        moved = np.full(len(held), -1, np.int32)
        moved[kept] = place[: len(kept)]
        self.at, self.ids = moved[self.at], every.take(pa.array(order))
        return place[len(kept) :]

    def meet(self, corpus: np.ndarray, places: np.ndarray, groups: np.ndarray | None = None, of: np.ndarray | None = None) -> None:
        """``places``: of the rows' ids, from :meth:`learn`; ``groups``: numbers that mustn't equal the query's; ``of``: the queries that meet these rows."""
        of = np.arange(len(self.queries)) if of is None else of
        b = 0
        while b < len(places):
            part = slice(b, b + min(_BLOCK, max(_FIRST, self.met)))
            rows = corpus[part]
            short, size = rows.astype(np.float32), _longest(rows)
            for a in range(0, len(of), 256):
                self._meet(of[a : a + 256], rows, short, size, places[part], None if groups is None else groups[part])
            self.met += len(rows)
            b = part.stop

    def _meet(self, rows: np.ndarray, corpus: np.ndarray, short: np.ndarray, size: float, places: np.ndarray, groups: np.ndarray | None) -> None:
        mine = self.queries[rows] if isinstance(self.queries, np.ndarray) else _unit(self.queries.take(pa.array(rows)))
        # only what may pass is rounded
        least = np.maximum(self.sims[rows, -1], self.floor) - 10.0**-DIGITS
        # single precision is off by less than this; what may pass by it is worked out in double
        off = (corpus.shape[1] + 4) * 2.0**-23 * size * _longest(mine)
        near = None
        if np.count_nonzero(least == -np.inf) * len(places) <= _SCREENED:
            near = mine.astype(np.float32) @ short.T >= (least - off).astype(np.float32)[:, None]
        if near is not None and np.count_nonzero(near) <= _SCREENED:
            i, j = np.divmod(np.flatnonzero(near), len(places))
            if groups is not None:
                other = self.groups[rows[i]] != groups[j]
                i, j = i[other], j[other]
            s = np.empty(len(i))
            for a in range(0, len(i), _AT_ONCE):
                s[a : a + _AT_ONCE] = np.einsum("ij,ij->i", mine[i[a : a + _AT_ONCE]], corpus[j[a : a + _AT_ONCE]])
        else:
            sims = mine @ corpus.T
            if groups is not None:
                sims[self.groups[rows, None] == groups[None, :]] = -np.inf
            near = sims >= least[:, None]
            if self.k < len(places) and np.count_nonzero(near) > 4 * self.k * len(rows):
                near = sims >= np.maximum(least, np.partition(sims, -self.k, axis=1)[:, -self.k] - 10.0**-DIGITS)[:, None]
            i, j = np.nonzero(near)
            s = sims[i, j]
        s, p = np.round(s, DIGITS), places[j]
        last, last_at = self.sims[rows, -1][i], self.at[rows, -1][i]
        ok = ((s > last) | ((s == last) & (p < last_at))) & (s >= self.floor)
        if not ok.any():
            return
        touched, i = np.unique(i[ok], return_inverse=True)
        held = rows[touched]
        q = np.concatenate([np.repeat(np.arange(len(held)), self.k), i])
        s, p = np.concatenate([self.sims[held].ravel(), s[ok]]), np.concatenate([self.at[held].ravel(), p[ok]])
        order = np.lexsort((p, -s, q))
        q = q[order]
        order = order[np.arange(len(q)) - np.searchsorted(q, q) < self.k]  # k of each: it had as many before
        self.sims[held], self.at[held] = s[order].reshape(-1, self.k), p[order].reshape(-1, self.k)

    def rows(self, names: pa.Array, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        """(query_id, item_id, similarity) in batches of bounded size."""
        step = max(1, 65_536 // self.k)
        for a in range(0, len(self.queries) if self.ids is not None else 0, step):
            at = self.at[a : a + step]
            q, nth = np.nonzero(at >= 0)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(a + q)), self.ids.take(pa.array(at[q, nth])).cast(id_type), pa.array(self.sims[a : a + step][q, nth])], ["query_id", "item_id", "similarity"])


def held_bytes(n: int, dims: int, k: int) -> int:
    """What ``n`` queries and the ``k`` best of each take in a task, about."""
    return n * (dims * 8 + k * 16)


def _search(mine: pa.Table, batches: Iterator[pa.RecordBatch], k: int, id_type: pa.DataType, floor: float = -np.inf) -> Iterator[pa.RecordBatch]:
    """The k best rows over all ``batches`` of each query in ``mine`` (columns query_id, embedding, perhaps group_id)."""
    grouped = "group_id" in mine.column_names
    known = codes = None
    if grouped:
        known = mine["group_id"].combine_chunks().unique()
        codes = pc.index_in(mine["group_id"].combine_chunks(), value_set=known).to_numpy(zero_copy_only=False)
    best = Best(mine["embedding"].combine_chunks(), k, codes, floor)
    for batch in batches:
        for a in range(0, batch.num_rows, _BLOCK):
            part = batch.slice(a, _BLOCK)
            theirs = pc.index_in(part["group_id"], value_set=known).fill_null(-1).to_numpy(zero_copy_only=False) if grouped else None
            if len(mine) and len(part):
                best.meet(_unit(part["embedding"]), best.learn(part["item_id"]), theirs)
    yield from best.rows(mine["query_id"].combine_chunks(), id_type)


def found_by_task(queries: DataFrame, corpus: DataFrame, k: int, exclude_group: bool = False, floor: float = -np.inf) -> DataFrame:
    """(query_id, item_id, similarity): the k best rows of each query among those that one task has seen."""
    extra = ["group_id"] if exclude_group else []
    queries = queries.where("embedding IS NOT NULL").select("query_id", "embedding", *extra)
    corpus = corpus.where("embedding IS NOT NULL").select("item_id", "embedding", *extra)
    schema = f"query_id {dict(queries.dtypes)['query_id']}, item_id {dict(corpus.dtypes)['item_id']}, similarity double"
    name_type, id_type = to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(corpus.schema["item_id"].dataType)
    n, dims = queries.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    if held_bytes(n, dims, k) <= MAX_BROADCAST_BYTES:
        # a broadcast: what the function itself holds is kept by a worker as pickled bytes, too
        held = queries.sparkSession.sparkContext.broadcast(queries.toArrow().combine_chunks())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _search(held.value, batches, k, id_type, floor)

        return corpus.mapInArrow(run, schema)
    # Blocks of bounded bytes on both sides; each pair of blocks is one group.
    blocks = lambda bytes: max(1, -(-bytes // MAX_BROADCAST_BYTES))
    qb, cb = blocks(held_bytes(n, dims, k)), blocks(corpus.count() * dims * 8)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    names = queries.columns
    left = queries.select(*(F.col(c).alias(f"q_{c}") for c in names), F.pmod(F.xxhash64("query_id"), F.lit(qb)).alias("qb"), every(cb).alias("cb"))
    right = corpus.select("*", F.pmod(F.xxhash64("item_id"), F.lit(cb)).alias("cb"), every(qb).alias("qb"))
    empty = pa.table([pa.array([], t) for t in (name_type, id_type, pa.float64())], ["query_id", "item_id", "similarity"])

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        if not len(q) or not len(c):
            return empty
        mine = q.select([f"q_{x}" for x in names]).rename_columns(names)
        return pa.Table.from_batches([*empty.to_batches(), *_search(mine, iter(c.to_batches()), k, id_type, floor)], empty.schema)

    # a task of its own for most pairs of blocks: fewer partitions, as Spark would merge them, leave some tasks several
    left, right = (side.repartition(4 * qb * cb, "qb", "cb") for side in (left, right))
    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(meet, schema)


def nearest(queries: DataFrame, corpus: DataFrame, k: int, exclude_group: bool = False, floor: float = -np.inf) -> DataFrame:
    """(query_id, item_id, similarity, rank): the k nearest rows of ``corpus`` to each query by cosine.

    ``queries``: query_id, embedding; ``corpus``: item_id, embedding; null vectors are left
    out, ties go to the smaller item_id.  With ``exclude_group`` both sides have a column
    ``group_id``, and rows of the query's own group don't count; nor do rows whose
    similarity is below ``floor``.

    The corpus is read once and not shuffled: each task holds all queries and one block of
    the corpus, keeps k rows per query over all its blocks, and a window ranks what the
    tasks sent, k rows per query and task.  Queries that take more than
    MAX_BROADCAST_BYTES with the k best of each are dealt into blocks which meet every
    block of the corpus, so that a task's memory doesn't grow with either.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id")
    return found_by_task(queries, corpus, k, exclude_group, floor).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Sampled vectors among which pivots are chosen, and on which the number of pivots is weighed up.
PIVOT_SAMPLE = 4_000
#: Numbers of pivots that are weighed up.
PIVOTS = (1, 4, 16, 64, 256, 1024)
#: What it costs to copy a vector to one more pivot, in comparisons of two vectors.
COPY_COST = 2_000


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1.0, 1.0))


def _farthest_first(sample: np.ndarray, n: int) -> np.ndarray:
    """Places of ``n`` vectors, each the farthest from those before it; fewer where the rest repeat them."""
    chosen, near = [0], _angles(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)) and near.max() > 1e-6:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _angles(sample, sample[chosen[-1:]])[:, 0])
    return np.array(chosen)


class _Pivots:
    """Cells around pivots: where a vector is at home, and in which cells before its own it may have a neighbour.

    Within an angle t of x, at home at p, lies no y that is farther from p than the cell's
    radius and t, or more than 2 t farther than from its own pivot.  A pair with homes p
    and q is met in the first of both cells.
    """

    def __init__(self, pivots: np.ndarray, angle: float, radius: np.ndarray | None = None):
        self.pivots, self.angle = pivots, angle
        self.radius = np.full(len(pivots), np.pi) if radius is None else radius

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = _angles(x, self.pivots)
        return d.argmin(1), d.min(1)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, distance to its pivot, whether it is at home there)."""
        d = _angles(x, self.pivots)
        home, own = d.argmin(1), d.min(1)
        reach = np.minimum(self.radius[None, :] + self.angle, own[:, None] + 2 * self.angle)
        inside = (d <= reach) & (np.arange(len(self.pivots))[None, :] < home[:, None])
        inside[np.arange(len(x)), home] = True
        row, cell = np.nonzero(inside)
        return row, cell, d[row, cell], cell == home[row]

    def cost(self, sample: np.ndarray, n: int) -> float:
        """Comparisons and copies of ``n`` vectors like the sample's."""
        home, own = self.homes(sample)
        radius = np.zeros(len(self.pivots))
        np.maximum.at(radius, home, own)
        _, cell, _, at_home = _Pivots(self.pivots, self.angle, radius).cells(sample)
        inner, outer = (np.bincount(cell[at_home == k], minlength=len(self.pivots)) * (n / len(sample)) for k in (True, False))
        return float((inner * (inner / 2 + outer)).sum() + COPY_COST * (inner + outer).sum())


def _meetings(vectors: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, float] | None:
    """Both sides of what has to be compared, dealt into tasks (p, r, c), and the angle; None without vectors."""
    rows = vectors.where("embedding IS NOT NULL").select("item_id", "embedding")
    n, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    if not n:
        return None
    # what rounding may hide: similarities have DIGITS decimals, and small angles few digits
    angle = float(np.arccos(np.clip(threshold - 10.0**-DIGITS, -1.0, 1.0))) + 1e-6
    pivots = _Pivots(np.zeros((1, dims)), np.pi)
    if threshold > 0:
        # a zero vector is similar to nothing, and has no angle
        rows = rows.where(F.exists("embedding", lambda v: v != 0))
        taken = rows.orderBy(F.xxhash64("item_id", F.lit(11)), "item_id").limit(PIVOT_SAMPLE).toArrow()
        if not len(taken):
            return None
        sample = _unit(taken["embedding"].combine_chunks())
        order = _farthest_first(sample, PIVOTS[-1])
        pivots = min((_Pivots(sample[order[:k]], angle) for k in PIVOTS), key=lambda p: p.cost(sample, n))
    kind = dict(rows.dtypes)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, _BLOCK):
                cell, d = pivots.homes(_unit(batch["embedding"].slice(a, _BLOCK)))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(d)], ["cell", "d"])

    if len(pivots.pivots) > 1:
        radius = np.zeros(len(pivots.pivots))
        for r in rows.select("item_id", "embedding").mapInArrow(home, "cell int, d double").groupBy("cell").agg(F.max("d").alias("d")).collect():
            radius[r.cell] = r.d + 1e-6
        pivots = _Pivots(pivots.pivots, angle, radius)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, _BLOCK):
                batch = whole.slice(a, _BLOCK)
                row, cell, d, at_home = pivots.cells(_unit(batch["embedding"]))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch["item_id"].take(at), batch["embedding"].take(at), pa.array(cell.astype(np.int32)), pa.array(d), pa.array(at_home)], ["item_id", "embedding", "cell", "d", "at_home"])

    dealt = rows.mapInArrow(deal, f"item_id {kind['item_id']}, embedding {kind['embedding']}, cell int, d double, at_home boolean")
    block = min(max(1, MAX_BROADCAST_BYTES // (max(1, dims) * 8)), max(1000, -(-n // 8)))
    blocks = lambda c: F.ceil(F.count_if(c) / F.lit(block)).cast("int")
    # a row for each pivot
    sizes = dealt.groupBy("cell").agg(blocks(F.col("at_home")).alias("inner"), blocks(~F.col("at_home")).alias("outer")).where("inner > 0")
    rows = dealt.join(F.broadcast(sizes), "cell")
    own = F.pmod(F.xxhash64("item_id"), F.when(F.col("at_home"), F.col("inner")).otherwise(F.col("outer"))).cast("int")
    rows = rows.withColumn("mine", F.when(F.col("at_home"), own).otherwise(own + F.col("inner")))
    left = rows.where("at_home").select(F.col("cell").alias("p"), F.col("item_id").alias("i"), F.col("embedding").alias("x"), F.col("d").alias("dx"), F.col("mine").alias("r"), F.explode(F.expr("sequence(mine, inner + outer - 1)")).alias("c"))
    right = rows.select(F.col("cell").alias("p"), F.col("item_id").alias("j"), F.col("embedding").alias("y"), F.col("d").alias("dy"), F.explode(F.expr("sequence(0, IF(at_home, mine, inner - 1))")).alias("r"), F.col("mine").alias("c"))
    return left, right, angle if len(pivots.pivots) > 1 else np.pi


def _compared(vectors: DataFrame, threshold: float, count: bool) -> DataFrame:
    kind = dict(vectors.dtypes)["item_id"]
    sides = _meetings(vectors, threshold)
    if sides is None:
        return vectors.sparkSession.createDataFrame([], "compared long" if count else f"a {kind}, b {kind}, similarity double")
    left, right, angle = sides

    # one stream per task, each block of left rows before the right rows that meet it, both by distance to the pivot
    names = ["p", "r", "c", "item_id", "embedding", "d"]
    stream = left.toDF("p", "item_id", "embedding", "d", "r", "c").select(*names, F.lit(0).alias("side")).unionByName(right.toDF("p", "item_id", "embedding", "d", "r", "c").select(*names, F.lit(1).alias("side")))
    stream = stream.repartition("p", "r", "c").sortWithinPartitions("p", "r", "c", "side", "d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, block = None, [], None
        for batch in batches:
            at = np.stack([batch[x].to_numpy() for x in ("p", "r", "c", "side")])
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(at) != 0).any(axis=0)) + 1, [batch.num_rows]]).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                p, r, c, side = at[:, a].tolist()
                part = batch.slice(a, b - a)
                if place != (p, r, c):
                    place, held, block = (p, r, c), [], None
                if side == 0:
                    held.append((part["item_id"], _unit(part["embedding"]), part["d"].to_numpy()))
                elif held:
                    if block is None:
                        block, held = (pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])), held[:1]
                    yield from compare(*block, part, r == c)

    def compare(i_ids: pa.Array, x: np.ndarray, dx: np.ndarray, part: pa.RecordBatch, same: bool) -> Iterator[pa.RecordBatch]:
        compared = 0
        for b in range(0, part.num_rows, _TILE):
            j_ids, y, dy = part["item_id"].slice(b, _TILE), _unit(part["embedding"].slice(b, _TILE)), part["d"].slice(b, _TILE).to_numpy()
            # vectors whose distances to the pivot differ by more than the angle are farther apart
            lo, hi = np.searchsorted(dx, dy[0] - angle), np.searchsorted(dx, dy[-1] + angle, "right")
            compared += len(dy) * int(hi - lo)
            for a in range(lo, hi, _TILE):
                sims = x[a : min(a + _TILE, hi)] @ y.T
                i, j = np.nonzero(sims >= threshold - 10.0**-DIGITS)  # only what may pass is rounded
                s = np.round(sims[i, j], DIGITS)
                passed = np.flatnonzero(s >= threshold)
                for n in range(0, 0 if count else len(passed), _PAIRS):
                    ok = passed[n : n + _PAIRS]
                    p, q = i_ids.take(pa.array(a + i[ok])), j_ids.take(pa.array(j[ok]))
                    first = pc.less(p, q)
                    kept = first if same else pc.not_equal(p, q)
                    pairs = [pc.if_else(first, p, q), pc.if_else(first, q, p), pa.array(s[ok])]
                    yield pa.RecordBatch.from_arrays([v.filter(kept) for v in pairs], ["a", "b", "similarity"])
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([compared], pa.int64())], ["compared"])

    return stream.mapInArrow(run, "compared long" if count else f"a {kind}, b {kind}, similarity double")


def pairs_above(vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) with a < b and cosine similarity of ``threshold`` or more, each pair once.

    Exact.  Vectors are at home in the cell of their nearest pivot and copied to those
    other cells in which a neighbour may be at home by the triangle inequality of angles;
    inside a cell only vectors whose distances to the pivot differ by at most the angle are
    compared.  The number of pivots is the one that costs least on a bounded sample: many
    for vectors in clusters, one for vectors that are all far apart, where every pair has
    to be compared.  Cells are compared in blocks of at most MAX_BROADCAST_BYTES; a task
    holds one such block and a tile of the other, and pairs that pass leave it as they are
    found, however many they are.
    """
    return _compared(vectors, threshold, False)


def comparisons(vectors: DataFrame, threshold: float) -> int:
    """How many pairs :func:`pairs_above` compares."""
    return _compared(vectors, threshold, True).agg(F.coalesce(F.sum("compared"), F.lit(0))).first()[0]

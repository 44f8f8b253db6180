"""Quality classifier by co-training of two views.

One classifier sees a text's content only, the other its metadata only (source, language,
length).  Both start from a bounded sample of labelled documents.  In each round each
view labels the unlabelled documents it is sure of, over the whole table, and the other
learns from these labels.  Each view is then calibrated on labelled documents held out
from training, and a small logistic model of the two calibrated views, fitted on yet
other held-out documents, gives the score.  A view that knows nothing ends up with
hardly any weight, and isn't sure of anything, so it teaches nothing.

Features are computed once and written to a scratch table.  A step of training reads that
table once: each task sums gradient and curvature over its rows, sums are added up in
rounds of bounded size, and the driver, which holds the labelled sample and nothing else
of the corpus, moves the weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopspark.llm.common import give_back, scratch_table, slices

SCHEMA = "doc_id long, p_text double, p_meta double, score double, kept boolean"

#: Default of ``max_labelled``: most labelled documents that training looks at, chosen by
#: a hash of the identifier (half a kilobyte each, held by the driver).
MAX_LABELLED = 20_000
#: Rounds of exchange, and Newton steps in each.
ROUNDS, STEPS = 3, 2
#: How sure a view must be of a document to label it for the other.
SURE = 0.95
#: Weight of all labels from the other view together, as a share of the given ones.
WEIGHT = 1.0
KEEP = 0.5
#: Labels (some 50 bytes each) up to which they are broadcast.
BROADCAST_LABELS = 500_000
#: Sums added up in one task or on the driver at once (0.4 MB each).
FAN_IN = 32
#: Folds of labelled documents, of ten: those below the first train, then calibrate, then join.
CALIBRATE, JOIN = 6, 8

TRIGRAMS, SOURCES, LANGS, SIZES = 192, 64, 16, 18
_STATS = 12
TEXT_WIDTH, META_WIDTH = TRIGRAMS + _STATS, SOURCES + LANGS + SIZES


def text_features(data: bytes) -> np.ndarray:
    """Shares of hashed byte trigrams, and of kinds of characters, words and lines."""
    out = np.zeros(TEXT_WIDTH, np.float32)
    b = np.frombuffer(data, np.uint8)
    n = len(b)
    if n == 0:
        out[-1] = 1
        return out
    if n > 2:
        w = b.astype(np.uint32)
        code = (w[:-2] * np.uint32(0x9E3779B1) + w[1:-1] * np.uint32(0x85EBCA6B) + w[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(16)
        out[:TRIGRAMS] = np.sqrt(np.bincount(code % TRIGRAMS, minlength=TRIGRAMS) / (n - 2))
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    kinds = np.bincount(_KIND[b], minlength=8) / n
    out[TRIGRAMS : TRIGRAMS + 8] = np.sqrt(kinds)
    out[TRIGRAMS + 8] = len(set(words)) / max(1, len(words))
    out[TRIGRAMS + 9] = len(set(lines)) / max(1, len(lines))
    out[TRIGRAMS + 10] = min(1.0, n / max(1, len(words)) / 20)
    return out


def _kinds() -> np.ndarray:
    """Class of each byte: 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 sentence mark, 6 symbol, 7 beyond ASCII."""
    kind = np.zeros(256, np.int64)
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\x0b\x0c\r", b".,;:!?'\"()-", b"#*$%&|<>{}[]\\/=+_~^@"), 1):
        kind[list(chars)] = k
    kind[128:] = 7
    return kind


_KIND = _kinds()


def meta_codes(source: str | None, lang: str | None, n_chars: int | None) -> bytes:
    """Hashed source and language, and the order of magnitude of the length, a byte each; nulls have places of their own."""
    s = zlib.crc32(b"\0" if source is None else source.encode()) % SOURCES
    g = zlib.crc32(b"\0" if lang is None else lang.encode()) % LANGS
    size = SIZES - 1 if n_chars is None or n_chars < 0 else min(SIZES - 2, int(np.log2(n_chars + 1) * 0.8))
    return bytes((s, g, size))


def matrices(text: list[bytes], meta: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two views of rows as they are stored, a last column of ones in each."""
    n = len(text)
    x = np.ones((n, TEXT_WIDTH + 1), np.float32)
    x[:, :-1] = np.frombuffer(b"".join(text), np.float16).reshape(n, TEXT_WIDTH)
    codes = np.frombuffer(b"".join(meta), np.uint8).reshape(n, 3).astype(np.int64)
    m = np.zeros((n, META_WIDTH + 1), np.float32)
    for k, start in enumerate((0, SOURCES, SOURCES + LANGS)):
        m[np.arange(n), codes[:, k] + start] = 1
    m[:, -1] = 1
    return x, m


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def slopes(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the logistic loss, summed over rows."""
    p = sigmoid(x.astype(np.float64) @ w)
    return x.T @ (p - y), (x * (p * (1 - p)).astype(x.dtype)[:, None]).T @ x


def newton(w: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, ridge: float) -> np.ndarray:
    """The weights after a step; the last, the intercept, has hardly any penalty."""
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    return w - np.linalg.solve(curvature + np.diag(penalty), gradient + penalty * w)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> np.ndarray:
    """Weights for ``x``, whose last column is ones, by Newton's method."""
    x = x.astype(np.float64)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        new = newton(w, *slopes(x, y, w), ridge)
        done = np.abs(new - w).max() < 1e-6
        w = new
        if done:
            break
    return w


def _line(odds: np.ndarray) -> np.ndarray:
    return np.column_stack([odds, np.ones(len(odds))])


@dataclass
class Model:
    """The two views, their calibrations (slope, intercept) and the weights that combine them."""

    views: tuple[np.ndarray, np.ndarray]
    scales: tuple[np.ndarray, np.ndarray]
    join: np.ndarray
    prior: float | None = None
    #: Labels given by each view to the other in the last round.
    pseudo: int = 0

    def odds(self, x: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """Calibrated log-odds of each view."""
        return [_line(v.astype(np.float64) @ w) @ s for v, w, s in zip(x, self.views, self.scales, strict=True)]

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.prior is not None:
            same = np.full(len(text), self.prior)
            return same, same, same
        odds = self.odds((text, meta))
        return sigmoid(odds[0]), sigmoid(odds[1]), sigmoid(_line(np.column_stack(odds)) @ self.join)


def teach(judge: Model, views: tuple[np.ndarray, np.ndarray], x: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sums over unlabelled rows: for each view and class, the number of rows that the other view of ``judge`` is sure of, and their slopes."""
    odds, least = judge.odds(x), np.log(SURE / (1 - SURE))
    out = []
    for me, other in ((0, 1), (1, 0)):
        upper = np.triu_indices(len(views[me]))
        for c, sure in ((0, -odds[other] >= least), (1, odds[other] >= least)):
            rows = x[me][sure]
            gradient, curvature = slopes(rows, np.float64(c), views[me])
            out += [[float(len(rows))], gradient, curvature[upper]]
    return np.concatenate(out).astype(np.float64)


def _parts(sums: np.ndarray, widths: tuple[int, int]) -> Iterator[tuple[int, int, float, np.ndarray, np.ndarray]]:
    """(view, class, rows, gradient, curvature) out of :func:`teach`."""
    at = 0
    for me, d in enumerate(widths):
        upper = np.triu_indices(d)
        for c in (0, 1):
            n, gradient = sums[at], sums[at + 1 : at + 1 + d]
            half = np.zeros((d, d))
            half[upper] = sums[at + 1 + d : at + 1 + d + len(upper[0])]
            at += 1 + d + len(upper[0])
            yield me, c, n, gradient, half + np.triu(half, 1).T


def co_train(x: tuple[np.ndarray, np.ndarray], label: np.ndarray, fold: np.ndarray, gather: Callable[[Model, tuple], np.ndarray], rounds: int = ROUNDS) -> Model:
    """Fit on labelled rows ``x`` (both views, ones last), of ``fold`` 0 to 9, and on what ``gather`` sums up over all others.

    ``gather(judge, views)`` returns :func:`teach` over the whole pool.  With fewer than
    five examples of a class for training, calibration or joining there is nothing to
    learn: the model is then the labels' mean (0.5 without any).
    """
    train, calib, last = fold < CALIBRATE, (fold >= CALIBRATE) & (fold < JOIN), fold >= JOIN
    if min([(label[m] == c).sum() for m in (train, calib, last) for c in (0, 1)], default=0) < 5:
        none = np.zeros(1)
        return Model((none, none), (none, none), none, float(label.mean()) if len(label) else 0.5)
    calibrate = lambda views: tuple(fit_logistic(_line(v[calib].astype(np.float64) @ w), label[calib], 1e-3) for v, w in zip(x, views, strict=True))
    views = tuple(fit_logistic(v[train], label[train]) for v in x)
    pseudo = 0
    for _ in range(rounds):
        judge = Model(views, calibrate(views), np.zeros(3))
        for _ in range(STEPS):
            steps = [list(slopes(v[train].astype(np.float64), label[train], w)) for v, w in zip(x, views, strict=True)]
            pseudo = 0
            for me, c, n, gradient, curvature in _parts(gather(judge, views), tuple(map(len, views))):
                weight = min(1.0, WEIGHT * (label[train] == c).sum() / max(n, 1))
                steps[me][0] = steps[me][0] + weight * gradient
                steps[me][1] = steps[me][1] + weight * curvature
                pseudo += int(n)
            views = tuple(newton(w, *s, 1.0) for w, s in zip(views, steps, strict=True))
    model = Model(views, calibrate(views), np.zeros(3), None, pseudo)
    odds = np.column_stack(model.odds(tuple(v[last] for v in x)))
    model.join = fit_logistic(_line(odds), label[last], 0.1)
    return model


def features(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, text, meta, label) for every row of ``docs``: its features as bytes, its label or null; a scratch table."""
    have = set(docs.columns)
    pick = lambda name, kind: (docs[name] if name in have else F.lit(None)).cast(kind).alias(name)
    rows = docs.select(pick("doc_id", "long"), F.coalesce(pick("text", "string"), F.lit("")).cast("binary").alias("data"), pick("source", "string"), pick("lang", "string"), pick("n_chars", "long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text = [text_features(x.as_py()).astype(np.float16).tobytes() for x in batch.column(1)]
            meta = [meta_codes(*row) for row in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.binary()), pa.array(meta, pa.binary())], ["doc_id", "text", "meta"])

    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    given = F.broadcast(given) if labels.count() <= BROADCAST_LABELS else given
    return scratch_table(rows.mapInArrow(run, "doc_id long, text binary, meta binary").join(given, "doc_id", "left"), "features")


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return matrices(batch.column("text").to_pylist(), batch.column("meta").to_pylist())


def pool_sums(pool: DataFrame) -> Callable[[Model, tuple], np.ndarray]:
    """:func:`teach` over all rows of ``pool`` (text, meta), in one pass.

    A task sends one row.  Where there are more than FAN_IN of them they are added up in
    further stages, FAN_IN at a time, so neither a task nor the driver holds many.
    """
    tasks = pool.rdd.getNumPartitions()

    def gather(judge: Model, views: tuple) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in slices(batches, 4096):
                part = teach(judge, views, _views(batch))
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])
            give_back()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0
            for batch in batches:
                for x in batch.column(0):
                    total = total + np.frombuffer(x.as_py())
            if isinstance(total, np.ndarray):
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        rows, n = pool.mapInArrow(run, "sums binary"), tasks
        while n > FAN_IN:
            n = -(-n // FAN_IN)
            rows = rows.repartition(n).mapInArrow(add, "sums binary")
        found = [np.frombuffer(bytes(r.sums)) for r in rows.collect()]
        width = sum(2 * (1 + len(w) + len(w) * (len(w) + 1) // 2) for w in views)
        return sum(found, np.zeros(width))

    return gather


def train(table: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS) -> Model:
    """Fit on ``table`` as :func:`features` makes it.

    Of the labelled rows at most ``max_labelled`` documents are used, by a hash of the
    identifier; of several rows with one doc_id the one with the smallest features.  Rows
    without a label all take part in the exchange, repeated ones each.
    """
    known = table.where("label IS NOT NULL").groupBy("doc_id", "label").agg(F.min(F.struct("text", "meta")).alias("x"))
    place = F.xxhash64("doc_id", F.lit(11))
    # Left behind in the tasks, so that they don't send max_labelled rows each: what can't be among the first, with a margin.
    share = min(1.0, 1.2 * max_labelled / max(1, known.count()) + 1e-3)
    near = known.where(place <= F.lit(min(int(share * (1 << 64)) - (1 << 63), (1 << 63) - 1)))
    rows = near.orderBy(place, "doc_id").limit(max_labelled).select("doc_id", "label", "x.*").collect()
    rows.sort(key=lambda r: r.doc_id)
    x = matrices([bytes(r.text) for r in rows], [bytes(r.meta) for r in rows])
    fold = np.array([zlib.crc32(r.doc_id.to_bytes(8, "little", signed=True)) % 10 for r in rows], int)
    return co_train(x, np.array([r.label for r in rows], float), fold, pool_sums(table.where("label IS NULL").select("text", "meta")), rounds)


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", keep: float = KEEP, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per row of ``docs``: each view's calibrated probability, the score, and whether it is kept.

    ``docs`` has doc_id and text, and may have source, lang and n_chars (a missing column
    counts as null).  Null and empty texts, null metadata and null ids are scored like
    any other row.  Labels other than 0 and 1 are left out; of several labels of a
    document the largest counts.  Without labels every score is 0.5 (kept); an empty
    table gives an empty one.
    """
    table = features(docs, labels, label)
    model = train(table, max_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            p_text, p_meta, score = model.score(*_views(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (p_text, p_meta, score, score >= keep))], [x.split()[0] for x in SCHEMA.split(", ")])

    return table.select("doc_id", "text", "meta").mapInArrow(run, SCHEMA)

"""Alignment of two tokenizers: which tokens end together, and how often a pair does so in the whole corpus.

1. Texts are encoded by both tokenizers.  Where a token of each ends at the same byte, the
   two are linked; the links of a text cut its tokens into groups.  Some megabytes of
   texts make a block, whose postings (pair of ids, text, number of links) are dealt into
   buckets by the id of the second tokenizer, the side by which counts are compared.
2. A block's distinct pairs are added up, which gives the corpus-wide count of each pair.
3. Counts and postings of a bucket meet as one sorted stream, the counts first.  Spark
   sorts it and spills as it needs; a task holds the counts of one bucket, whose size is
   bounded by the vocabularies, and one posting list at a time.  It finds each id's
   highest count and sends every block what its texts get from this bucket.
4. Blocks cogroup with these contributions by ``block_id``; a text's are summed there.

A common id's postings stay in one bucket but are salted by block as soon as the bucket
has more than SALT_BYTES of them; only its counts are repeated for each salt.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopspark.llm.blocks import pack, pack_ids, unpack, unpack_ids
from hopspark.llm.common import bucketed_table, give_back
from hopspark.llm.token_counts import _BEYOND

SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
#: The same pre-tokens as those of ``token_counts.PATTERN``, without going back over a run (fixed value).
QUICK_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Bounds of a block: characters of text, and texts.
BLOCK_CHARS, BLOCK_DOCS = 16_000_000, 50_000
#: Characters that are aligned in one go; a longer text is aligned by itself.
GO_CHARS = 1_000_000
#: Bytes of a bucket's packed postings for each salt.
SALT_BYTES = 64 << 20
#: Bytes of distinct words, with some for each word's ids, that a worker keeps; beyond, it starts anew.
KEPT_BYTES = 64 << 20

_BLOCKS = "block_id long, n_docs int, docs binary, packs array<struct<bucket: int, pairs: binary, postings: binary>>"


def _byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the rest in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class _ByteSide:
    """A byte-level tokenizer: its ids of space and text, which always spell it."""

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        own = json.loads(tok.to_str())
        if own["normalizer"] is not None or own["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("not a byte-level tokenizer without normaliser")
        letters, added = _byte_of_letter(), {x["id"] for x in own["added_tokens"]}
        names = [tok.id_to_token(k) for k in range(tok.get_vocab_size())]
        self.token_bytes = [x.encode() if k in added else bytes(map(letters.__getitem__, x)) for k, x in enumerate(names)]
        # its merges in order make tokens in order of their ids, so ids are ranks
        made = [own["model"]["vocab"]["".join(pair if isinstance(pair, list) else pair.split(" "))] for pair in own["model"]["merges"]]
        if made != sorted(made) or set(made) & added or not all(bytes([b]) in self.token_bytes[: made[0]] for b in range(256)):
            raise ValueError("ids aren't in order of merges")
        self.whole = tok.encode
        self.quick = tiktoken.Encoding("side", pat_str=QUICK_PATTERN, mergeable_ranks={x: k for k, x in enumerate(self.token_bytes) if k not in added}, special_tokens={}).encode_to_numpy

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Texts within the code points on which both libraries agree are encoded by the quicker one."""
        return [self.quick(" " + t, disallowed_special=()) if _BEYOND.search(t) is None else np.array(self.whole(" " + t, add_special_tokens=False).ids, np.uint32) for t in texts]


class _PieceSide:
    """A ``sentencepiece`` model that puts a space before each text: ids of texts, None where they don't spell space and text.

    No piece has a blank behind another character, so merges never cross a place where a
    blank follows something else: blanks and what follows them up to the next blank are
    encoded by themselves, each distinct run once in a worker.  A model with other pieces
    gets its texts whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.token_bytes = [bytes([int(sp.id_to_piece(k)[3:5], 16)]) if sp.is_byte(k) else sp.id_to_piece(k).replace("▁", " ").encode() for k in range(sp.get_piece_size())]
        self.blank = sp.piece_to_id("▁")
        apart = not any(re.search(rb"[^ ] ", x) for x in self.token_bytes) and not sp.is_unknown(self.blank)
        self.cut = re.compile(" +[^ ]*").findall if apart else lambda text: [text]
        self.encode = lambda words: sp.encode(words, num_threads=1)
        self._renew()

    def _renew(self) -> None:
        self.codes: defaultdict[str, int] = defaultdict()
        self.codes.default_factory = self.codes.__len__
        self.start = self.length = self.flat = np.zeros(0, np.int64)
        self.spelt = np.zeros(0, bool)
        self.size = 0

    def _encode_new(self) -> None:
        """Encode the words that were met for the first time, in one go."""
        new = list(islice(self.codes, len(self.start), None))
        lists = self.encode([w[1:] for w in new])
        lists = [[self.blank] if w == " " else x for w, x in zip(new, lists, strict=True)]
        data = [w.encode() for w in new]
        more = np.fromiter(map(len, lists), np.int64, len(lists))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(more) - more])
        self.length = np.concatenate([self.length, more])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(lists), np.int64, int(more.sum()))])
        spelt = [b"".join(map(self.token_bytes.__getitem__, x)) == d for x, d in zip(lists, data, strict=True)]
        self.spelt = np.concatenate([self.spelt, np.array(spelt, bool)])
        self.size += sum(map(len, data)) + 150 * len(new)

    def ids(self, texts: list[str]) -> list[np.ndarray | None]:
        if self.size > KEPT_BYTES:
            self._renew()
        found = [np.fromiter(map(self.codes.__getitem__, self.cut(" " + t)), np.int64) for t in texts]
        if len(self.codes) > len(self.start):
            self._encode_new()
        out: list[np.ndarray | None] = []
        for codes in found:
            if not self.spelt[codes].all():
                out.append(None)
                continue
            n = self.length[codes]
            ends = np.cumsum(n)
            out.append(self.flat[np.arange(ends[-1]) + np.repeat(self.start[codes] - (ends - n), n)])
        return out


class _Sides:
    """Both tokenizers, and what is looked up by their ids."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = _ByteSide(path_a), _PieceSide(path_b)
        self.size_of = [np.fromiter(map(len, x.token_bytes), np.int64, len(x.token_bytes)) for x in (self.a, self.b)]
        # decimals of each id with what follows it, in rows of equal width filled up with zero bytes: "7," and "7|" of a, "7," and "7;" of b
        spelt = [f"{k}{end}" for side, last in ((self.a, "|"), (self.b, ";")) for k in range(len(side.token_bytes)) for end in (",", last)]
        width = max(map(len, spelt))
        self.decimals = np.frombuffer("".join(x.ljust(width, "\0") for x in spelt).encode(), np.uint8).reshape(-1, width)
        self.spelt_size = np.fromiter(map(len, spelt), np.int64, len(spelt))


@cache
def _sides(path_a: str, path_b: str) -> _Sides:
    return _Sides(path_a, path_b)


def _aligned(texts: list[str], sides: _Sides) -> tuple[dict[str, np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Per-text counts and digests, and the links as (text, id of a, id of b).

    All texts are laid end to end: each that both sides spell has the same bytes on both,
    so its end is a common one.
    """
    given = [t for t in texts if t]
    both = iter(zip(sides.a.ids(given), sides.b.ids(given), strict=True))
    empty = np.zeros(0, np.int64)
    pairs = [next(both) if t else (empty, empty) for t in texts]
    pairs = [(empty, empty) if y is None else (x, y) for x, y in pairs]
    counts = [np.fromiter((len(p[k]) for p in pairs), np.int64, len(pairs)) for k in (0, 1)]
    ids = [np.concatenate([empty, *(p[k] for p in pairs)]).astype(np.int64) for k in (0, 1)]
    ends = [np.cumsum(size[x]) for size, x in zip(sides.size_of, ids, strict=True)]
    total = int(ends[0][-1]) if len(ends[0]) else 0
    closes = []
    for k in (0, 1):
        other = np.zeros(total + 1, bool)
        other[ends[1 - k]] = True
        closes.append(other[ends[k]])  # tokens that end where one of the other side does
    last = [np.flatnonzero(c) for c in closes]
    doc = np.repeat(np.arange(len(texts)), counts[0])[last[0]]
    groups = np.bincount(doc, minlength=len(texts))
    # a1,a2|b1;a3|b2,b3: a group's tokens of a come before those of b
    group = [np.cumsum(c) - c for c in closes]
    begin_b = np.concatenate([[0], last[1] + 1])
    line = np.empty(len(ids[0]) + len(ids[1]), np.int64)
    line[np.arange(len(ids[0])) + begin_b[group[0]]] = 2 * ids[0] + closes[0]
    line[np.arange(len(ids[1])) + last[0][group[1]] + 1] = 2 * (ids[1] + len(sides.a.token_bytes)) + closes[1]
    rows = sides.decimals[line].ravel()
    data = memoryview(rows[rows != 0].tobytes())
    bounds = np.concatenate([[0], np.cumsum(sides.spelt_size[line])])[np.concatenate([[0], np.cumsum(counts[0] + counts[1])])].tolist()
    digests = [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
    return {"n_a": counts[0], "n_b": counts[1], "n_groups": groups}, digests, doc, ids[0][last[0]], ids[1][last[1]]


class _Block:
    """Texts and postings of a block under construction."""

    def __init__(self, sides: _Sides, limits: tuple[int, int, int]):
        self.sides, self.wide = sides, len(sides.a.token_bytes)
        self.most_chars, self.most_docs, self.go_chars = limits
        self.ids: list = []
        self.waiting: list[str] = []
        self.counts: list[dict[str, np.ndarray]] = []
        self.digests: list[str] = []
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.chars = self.queued = 0

    def add(self, doc_id, text: str) -> None:
        self.ids.append(doc_id)
        self.waiting.append(text)
        self.chars += len(text)
        self.queued += len(text)
        if self.queued >= self.go_chars:
            self.go()

    def go(self) -> None:
        if not self.waiting:
            return
        counts, digests, doc, x, y = _aligned(self.waiting, self.sides)
        # (id of b, id of a, text) as one number: b ascends first, so a bucket's pairs are runs
        key = (y * self.wide + x) * self.most_docs + (doc + len(self.digests))
        key, times = np.unique(key, return_counts=True)
        self.counts.append(counts)
        self.digests += digests
        self.keys.append(key)
        self.times.append(times)
        self.waiting, self.queued = [], 0

    def full(self) -> bool:
        return self.chars >= self.most_chars or len(self.ids) >= self.most_docs

    def row(self, block_id: int, buckets: int) -> dict:
        self.go()
        digests = b"".join(bytes.fromhex(d) if d else bytes(32) for d in self.digests)
        parts = [pack_ids(self.ids), *(pack(np.concatenate([c[k] for c in self.counts])) for k in ("n_a", "n_b", "n_groups")), digests]
        heads = np.array([len(p) for p in parts], "<u4").tobytes()
        key, times = np.concatenate(self.keys), np.concatenate(self.times)
        order = np.argsort(key)
        key, times = key[order], times[order]
        pair, doc = key // self.most_docs, key % self.most_docs
        bucket = pair // self.wide % buckets
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        packs = []
        for k in range(buckets):
            mine = order[cuts[k] : cuts[k + 1]]
            if len(mine):
                p, first, n = np.unique(pair[mine], return_index=True, return_counts=True)
                total = np.add.reduceat(times[mine], first)
                packs.append({"bucket": k, "pairs": _put(p // self.wide, p % self.wide, total), "postings": _put(p // self.wide, p % self.wide, n, doc[mine], times[mine])})
        return {"block_id": block_id, "n_docs": len(self.ids), "docs": heads + b"".join(parts), "packs": packs}


def _put(*arrays: np.ndarray) -> bytes:
    parts = [pack(x) for x in arrays]
    return np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def _take(data: bytes) -> list[np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    ends = 4 + 4 * n + np.concatenate([[0], np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64)])
    return [unpack(data[x:y]).astype(np.int64) for x, y in zip(ends[:-1], ends[1:], strict=True)]


def _aligned_blocks(docs: DataFrame, path_a: str, path_b: str, buckets: int) -> DataFrame:
    schema = pa.schema([("block_id", pa.int64()), ("n_docs", pa.int32()), ("docs", pa.binary()), ("packs", pa.list_(pa.struct([("bucket", pa.int32()), ("pairs", pa.binary()), ("postings", pa.binary())])))])

    limits = BLOCK_CHARS, BLOCK_DOCS, GO_CHARS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(path_a, path_b)
        part, made, block = TaskContext.get().partitionId(), 0, _Block(sides, limits)
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                block.add(key.as_py(), value.as_py() or "")
                if block.full():
                    yield pa.RecordBatch.from_pylist([block.row(part << 32 | made, buckets)], schema)
                    made, block = made + 1, _Block(sides, limits)
        if block.ids:
            yield pa.RecordBatch.from_pylist([block.row(part << 32 | made, buckets)], schema)
        del block
        give_back()

    return bucketed_table(docs.mapInArrow(run, _BLOCKS), "aligned", "block_id", buckets)


def _pair_counts(packs: DataFrame) -> DataFrame:
    """(bucket, b, a, total): the corpus-wide count of each pair of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, data in zip(batch.column(0), batch.column(1), strict=True):
                b, a, total = _take(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), bucket.as_py(), np.int32)), pa.array(b.astype(np.int32)), pa.array(a.astype(np.int32)), pa.array(total)], ["bucket", "b", "a", "total"])

    rows = packs.select("bucket", "pairs").mapInArrow(run, "bucket int, b int, a int, total long")
    return rows.groupBy("bucket", "b", "a").agg(F.sum("total").alias("total"))


class _Counts:
    """The counts of a bucket's pairs, and of each whether it is the highest of its second id."""

    def __init__(self, pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        b, a, self.total = (np.concatenate(x) for x in zip(*pieces, strict=True))
        self.pair = b << 32 | a
        first = np.flatnonzero(np.diff(b, prepend=-1))
        top = np.maximum.reduceat(self.total, first)
        self.best = self.total == np.repeat(top, np.diff(np.append(first, len(b))))

    def of(self, b: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.pair, b << 32 | a)
        return self.total[at], self.best[at]


def _contributions(counts: DataFrame, packs: DataFrame, buckets: int) -> DataFrame:
    """(block_id, given): for each block and bucket, what the block's texts get."""
    # one row per bucket, whatever the corpus; a hot bucket's salts share its postings by block
    weight = packs.groupBy("bucket").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.length("postings")) / F.lit(SALT_BYTES))).cast("int").alias("salts"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    left = counts.join(F.broadcast(weight), "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "b", "a", "total", none("long", "block_id"), none("binary", "postings"))
    right = packs.join(F.broadcast(weight), "bucket").select("bucket", F.pmod(F.xxhash64("block_id"), "salts").cast("int").alias("salt"), none("int", "b"), none("int", "a"), none("long", "total"), "block_id", "postings")
    stream = left.unionByName(right).repartition(buckets, "bucket", "salt").sortWithinPartitions("bucket", "salt", F.col("b").asc_nulls_last(), "a", "block_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, pieces, known = None, [], None
        for batch in batches:
            at = np.stack([batch.column(k).to_numpy() for k in (0, 1)])
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(at) != 0).any(axis=0)) + 1, [batch.num_rows]]).tolist()
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if place != (place := (int(at[0, x]), int(at[1, x]))):
                    pieces, known = [], None
                part = batch.slice(x, y - x)
                n = part.num_rows - part.column(2).null_count
                if n:
                    pieces.append(tuple(part.column(k).slice(0, n).to_numpy().astype(np.int64) for k in (2, 3, 4)))
                for block_id, data in zip(part.column(5).slice(n), part.column(6).slice(n), strict=True):
                    if known is None:
                        known, pieces = _Counts(pieces), []
                    b, a, docs_of, doc, times = _take(data.as_py())
                    total, best = known.of(b, a)
                    total, best = np.repeat(total, docs_of) * times, np.repeat(best, docs_of) * times
                    seen, where = np.unique(doc, return_inverse=True)
                    sums = np.zeros(len(seen), np.int64)
                    np.add.at(sums, where, total)
                    wins = np.bincount(where, best).astype(np.int64)
                    given = _put(seen, wins, sums & 0xFFFFFFFF, sums >> 32)
                    yield pa.RecordBatch.from_arrays([pa.array([block_id.as_py()], pa.int64()), pa.array([given], pa.binary())], ["block_id", "given"])
        give_back()

    return stream.mapInArrow(run, "block_id long, given binary")


def _rows(block: pa.Table, given: pa.Table) -> pa.Table:
    """The rows of a block's texts, contributions summed."""
    row = block.select(["n_docs", "docs"]).to_pylist()[0]
    n, data = row["n_docs"], row["docs"]
    ends = np.concatenate([[20], 20 + np.cumsum(np.frombuffer(data, "<u4", 5), dtype=np.int64)]).tolist()
    ids, n_a, n_b, n_groups, digests = (data[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True))
    n_a, n_b, n_groups = (unpack(x).astype(np.int64) for x in (n_a, n_b, n_groups))
    best, sums = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for piece in given.column("given"):
        doc, wins, low, high = _take(piece.as_py())
        best[doc] += wins
        sums[doc] += high << 32 | low
    hexes = [digests[32 * k : 32 * k + 32].hex() if n_groups[k] else "" for k in range(n)]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.table([pa.array(unpack_ids(ids, n), pa.int64()), *map(pa.array, (n_a, n_b, n_groups, n_groups, best, sums)), pa.array(hexes, pa.string())], names)


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: tokens of both, groups, links, and what the corpus makes of the links.

    ``path_a``: a byte-level ``tokenizers`` file, given a space and the text; ``path_b``: a
    ``sentencepiece`` model that adds the space itself.  Special tokens' strings are plain
    text.  Every token has at least a byte, so one token of each ends at a common place:
    a group has one link, between its last tokens.  Null and empty texts, and those whose
    joined tokens of either side aren't the space and the text, have zeros and an empty
    digest and count for no pair.  Repeated rows and null ids count like any other; other
    columns are ignored; an empty table gives an empty one.
    """
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    blocks = _aligned_blocks(rows, path_a, path_b, buckets)
    packs = blocks.select("block_id", F.explode("packs").alias("p")).select("block_id", "p.*")
    given = _contributions(_pair_counts(packs), packs, buckets)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = _rows(left, right)
        give_back()
        return out

    own = blocks.select("block_id", "n_docs", "docs")
    return own.groupBy("block_id").cogroup(given.groupBy("block_id")).applyInArrow(run, SCHEMA)

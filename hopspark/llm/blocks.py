"""Dictionary-encoded blocks of texts, and one encoding for each distinct word in all of them.

A block holds some megabytes of texts as positions in a dictionary of the block's own
words.  What has to cross the network is then each block's dictionary, once, and not a
row for every word of every text:

1. :func:`text_blocks` cuts texts into words and writes the blocks to a scratch table,
   bucketed by ``block_id`` so that they needn't be shuffled again.  Each dictionary is
   dealt by the word's hash into ``buckets`` packs.
2. :func:`resolve` brings the packs of a bucket together, so that every occurrence of a
   word in any dictionary meets in one task, encodes each distinct word once there, and
   sends each block the values of its own words.
3. The caller cogroups these with the blocks by ``block_id`` and reassembles its texts.

A word occurs once per block, however common it is, so no bucket is hot; a block is
bounded in characters and in words (a single longer text makes a block by itself).

A task of step 2 holds the distinct words of its bucket, up to KEPT_WORDS (some 150 MB);
beyond that it starts anew, and words that come again are encoded again.  To encode each
word once, choose ``spark.sql.shuffle.partitions`` at no less than the number of distinct
words divided by KEPT_WORDS.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopspark.llm.common import bucketed_table, give_back

#: Bounds of a block: characters of text, and words in its dictionary.
BLOCK_CHARS = 32_000_000
BLOCK_WORDS = 400_000
#: Most words whose values a task holds.
KEPT_WORDS = 1_000_000

_BLOCKS = "block_id long, n_docs int, docs binary, n_words int, packs array<struct<bucket: int, at: binary, words: binary>>"
_VALUES = "block_id long, at binary, sizes binary, flat binary"


def pack(a: np.ndarray) -> bytes:
    """An array of unsigned integers, its byte planes compressed one by one."""
    a = np.ascontiguousarray(a, "<u4")
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pack_ids(ids: list) -> bytes:
    """Nullable 64-bit identifiers."""
    return zstandard.compress(pa.array(ids, pa.int64()).is_null().to_numpy(False).tobytes() + np.array([x or 0 for x in ids], "<i8").tobytes())


def unpack_ids(data: bytes, n: int) -> list:
    raw = zstandard.decompress(data)
    values = np.frombuffer(raw, "<i8", n, n).tolist()
    return [None if null else v for null, v in zip(raw[:n], values, strict=True)]


def _pack_words(words: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, words), "<u4", len(words))
    return zstandard.compress(len(words).to_bytes(4, "little") + sizes.tobytes() + b"".join(words), 3)


def _unpack_words(data: bytes) -> list[bytes]:
    raw = zstandard.decompress(data)
    n = int.from_bytes(raw[:4], "little")
    ends = (4 + 4 * n + np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64)).tolist()
    out, at = [], 4 + 4 * n
    for end in ends:
        out.append(raw[at:end])
        at = end
    return out


class _Block:
    """The texts of a block under construction."""

    def __init__(self, frequencies: bool):
        self.frequencies, self.chars = frequencies, 0
        self.ids: list = []
        self.sizes: list[int] = []
        self.counts: list[int] = []
        self.codes: list[np.ndarray] = []
        self.freqs: list[np.ndarray] = []
        self.words: defaultdict[str, int] = defaultdict()
        self.words.default_factory = self.words.__len__

    def add(self, doc_id, text: str, words: Iterable[str]) -> None:
        codes = np.fromiter(map(self.words.__getitem__, words), np.uint32)
        if self.frequencies:
            codes, freqs = np.unique(codes, return_counts=True)
            self.freqs.append(freqs.astype(np.uint32))
        self.ids.append(doc_id)
        self.sizes.append(len(text.encode()))
        self.counts.append(len(codes))
        self.codes.append(codes)
        self.chars += len(text)

    def full(self) -> bool:
        return self.chars >= BLOCK_CHARS or len(self.words) >= BLOCK_WORDS

    def row(self, block_id: int, buckets: int) -> dict:
        parts = [pack_ids(self.ids), pack(np.array(self.sizes)), pack(np.array(self.counts)), pack(np.concatenate(self.codes)), pack(np.concatenate(self.freqs or [np.zeros(0)]))]
        dealt: list[list[tuple[bytes, int]]] = [[] for _ in range(buckets)]
        for word, code in self.words.items():
            dealt[zlib.crc32(data := word.encode()) % buckets].append((data, code))
        packs = []
        for k, mine in enumerate(dealt):
            if mine:
                mine.sort()
                packs.append({"bucket": k, "at": pack(np.array([c for _, c in mine])), "words": _pack_words([w for w, _ in mine])})
        heads = np.array([len(p) for p in parts], "<u4").tobytes()
        return {"block_id": block_id, "n_docs": len(self.ids), "docs": heads + b"".join(parts), "n_words": len(self.words), "packs": packs}


def text_blocks(docs: DataFrame, words: Callable[[], Callable[[str], Iterable[str]]], frequencies: bool, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The scratch table of blocks of ``docs``; ``words()`` gives, in each worker, the function that cuts a text.

    With ``frequencies`` a text is kept as its distinct words and how often each occurs,
    else as the sequence of its words.  Null texts count as empty; ids may be null.
    """
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, part, made = words(), TaskContext.get().partitionId(), 0
        schema = pa.schema([("block_id", pa.int64()), ("n_docs", pa.int32()), ("docs", pa.binary()), ("n_words", pa.int32()), ("packs", pa.list_(pa.struct([("bucket", pa.int32()), ("at", pa.binary()), ("words", pa.binary())])))])
        block = _Block(frequencies)
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                value = value.as_py() or ""
                block.add(key.as_py(), value, cut(value))
                if block.full():
                    yield pa.RecordBatch.from_pylist([block.row(part << 32 | made, buckets)], schema)
                    made, block = made + 1, _Block(frequencies)
        if block.ids:
            yield pa.RecordBatch.from_pylist([block.row(part << 32 | made, buckets)], schema)
        del block
        give_back()

    cut = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, _BLOCKS)
    return bucketed_table(cut, "blocks", "block_id", buckets)


def resolve(blocks: DataFrame, encode: Callable[[], Callable[[str], list[int]]]) -> DataFrame:
    """For each block, in several rows: positions in its dictionary and the values of the words there.

    ``encode()`` gives, in each worker, the function from a word to its list of values.
    Packs of a bucket arrive one by one; what a task holds is the distinct words of its
    buckets and their values.
    """
    packs = blocks.select("block_id", F.explode("packs").alias("p")).select("block_id", "p.bucket", "p.at", "p.words")
    buckets = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encode()
        known: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if len(known) > KEPT_WORDS:
                    known.clear()
                values = []
                for word in _unpack_words(row["words"]):
                    v = known.get(word)
                    if v is None:
                        v = known[word] = np.array(of(word.decode()), np.uint32).tobytes()
                    values.append(v)
                sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block_id"]], pa.int64()), *(pa.array([x], pa.binary()) for x in (row["at"], pack(sizes), pack(np.frombuffer(b"".join(values), "<u4"))))],
                    [x.split()[0] for x in _VALUES.split(", ")],
                )
        known.clear()
        give_back()

    return packs.repartition(buckets, "bucket").mapInArrow(run, _VALUES)


class Texts:
    """A block with the values of its words, for reassembly."""

    def __init__(self, block: pa.Table, values: pa.Table):
        row = block.select(["n_docs", "docs", "n_words"]).to_pylist()[0]
        heads = np.frombuffer(row["docs"], "<u4", 5)
        ends = np.concatenate([[20], 20 + np.cumsum(heads, dtype=np.int64)])
        ids, *rest = (row["docs"][a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))
        self.ids = unpack_ids(ids, row["n_docs"])
        self.sizes, counts, self.codes, self.freqs = map(unpack, rest)
        self.bounds = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        at, sizes, flat = [], [], []
        for column, into in (("at", at), ("sizes", sizes), ("flat", flat)):
            into += [unpack(x.as_py()) for x in values.column(column)]
        empty = [np.zeros(0, np.uint32)]
        place, length = np.concatenate(at or empty), np.concatenate(sizes or empty).astype(np.int64)
        if len(place) != row["n_words"]:
            raise ValueError(f"values for {len(place)} of {row['n_words']} words")
        self.flat = np.concatenate(flat or empty)
        self.length = np.zeros(row["n_words"], np.int64)
        self.start = np.zeros(row["n_words"], np.int64)
        self.length[place] = length
        self.start[place] = np.cumsum(length) - length

    def words(self, k: int) -> np.ndarray:
        """Dictionary positions of text k."""
        return self.codes[self.bounds[k] : self.bounds[k + 1]]

    def values(self, k: int) -> np.ndarray:
        """The values of the words of text k, in order."""
        codes = self.words(k)
        length = self.length[codes]
        ends = np.cumsum(length)
        index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[codes] - (ends - length), length)
        return self.flat[index]


def reassemble(blocks: DataFrame, values: DataFrame, rows: Callable[[], Callable[[Texts], pa.Table]], schema: str) -> DataFrame:
    """Cogroup blocks with the values of their words; ``rows()`` gives the function that makes a block's rows."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = rows()(Texts(left, right))
        give_back()
        return out

    own = blocks.select("block_id", "n_docs", "docs", "n_words")
    return own.groupBy("block_id").cogroup(values.groupBy("block_id")).applyInArrow(run, schema)

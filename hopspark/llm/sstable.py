"""Token ids as sorted-string tables: one file per shard, looked up by binary search.

Documents are dealt into shards by range of their identifier and sorted inside, so the
shards in order hold all documents in order.  A file is::

    block*  index  bloom  footer  MAGIC

    block   entries in key order, then the CRC-32 of what precedes (4 bytes)
    entry   varint bytes shared with the previous key of the block, varint further bytes,
            varint length of the value, those key bytes, the value
    value   varint number of ids, the ids as little-endian unsigned integers of `width` bytes
    index   per block: varint length of its last key, that key, varint offset, varint length
    bloom   one bit array; probes by double hashing of the key's 128-bit digest
    footer  FOOTER, a fixed struct: offsets and lengths of index and bloom, number of
            probes, entries, ids, blocks, width, CRC-32 of index and bloom

A key is the identifier, eight bytes big-endian with the sign bit flipped after a byte 1
(a single byte 0 for null), so that byte order is numeric order, null first.  Only the
last key of each block is in the index; a lookup asks the Bloom filter, bisects the
index, and reads one block.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopspark.llm.common import give_back, open_file, read_files, scratch_path, scratch_table, write_files

MAGIC = b"HSST\x01\n"
FOOTER = struct.Struct("<QQQQIQQQII")
BLOCK_BYTES = 64_000
SHARD_BYTES = 8_000_000
BITS_PER_KEY, PROBES = 10, 7

_ROWS = "doc_id long, shard string, within long, n_tokens long, ids_crc32 long"


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + ((doc_id + (1 << 63)) & (1 << 64) - 1).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int, probes: int) -> Iterator[int]:
    digest = hashlib.blake2b(key, digest_size=16).digest()
    a, b = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little") | 1
    return ((a + k * b) % bits for k in range(probes))


class Writer:
    """Builds one file from entries in key order; repeated keys are kept."""

    def __init__(self, width: int = 2, block_bytes: int | None = None):
        self.width, self.block_bytes = width, block_bytes or BLOCK_BYTES
        self.out, self.size = [], 0
        self.block, self.block_size, self.last = [], 0, b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.ids = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            shared = next((k for k, (a, b) in enumerate(zip(key, self.last, strict=False)) if a != b), min(len(key), len(self.last)))
        value = _varint(len(ids)) + ids.astype(f"<u{self.width}").tobytes()
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.block_size += len(entry)
        self.last = key
        self.keys.append(key)
        self.ids += len(ids)
        if self.block_size >= self.block_bytes:
            self._close_block()

    def _close_block(self) -> None:
        data = b"".join(self.block)
        data += zlib.crc32(data).to_bytes(4, "little")
        self.index.append((self.last, self.size, len(data)))
        self.out.append(data)
        self.size += len(data)
        self.block, self.block_size = [], 0

    def finish(self) -> bytes:
        """The file without the closing MAGIC."""
        if self.block:
            self._close_block()
        index = b"".join(_varint(len(k)) + k + _varint(a) + _varint(n) for k, a, n in self.index)
        bits = max(64, BITS_PER_KEY * len(self.keys))
        bloom = np.zeros(bits, bool)
        for key in self.keys:
            bloom[list(_probes(key, bits, PROBES))] = True
        packed = np.packbits(bloom, bitorder="little").tobytes()
        footer = FOOTER.pack(self.size, len(index), self.size + len(index), bits, PROBES, len(self.keys), self.ids, len(self.index), self.width, zlib.crc32(index + packed))
        return b"".join([*self.out, index, packed, footer])


class Reader:
    """A file, MAGIC included: its bytes, or an open file, of which footer, index and Bloom filter are read, then blocks as they are asked for."""

    def __init__(self, source: bytes | pa.NativeFile):
        if isinstance(source, bytes):
            length, self.fetch = len(source), lambda at, n: source[at : at + n]
        else:
            length, self.fetch = source.size(), lambda at, n: source.read_at(n, at)
        end = length - len(MAGIC) - FOOTER.size
        tail = self.fetch(end, length - end) if end >= 0 else b""
        if tail[FOOTER.size :] != MAGIC:
            raise ValueError("no sorted-string table")
        begin, size, bloom_at, self.bits, self.probes, self.entries, self.ids, blocks, self.width, crc = FOOTER.unpack_from(tail)
        data = self.fetch(begin, end - begin)
        if zlib.crc32(data) != crc:
            raise ValueError("index or Bloom filter damaged")
        self.bloom = data[bloom_at - begin :]
        self.last: list[bytes] = []
        self.place: list[tuple[int, int]] = []
        at = 0
        while at < size:
            n, at = _read_varint(data, at)
            self.last.append(data[at : at + n])
            offset, at = _read_varint(data, at + n)
            n, at = _read_varint(data, at)
            self.place.append((offset, n))
        if len(self.last) != blocks:
            raise ValueError("index damaged")

    def may_contain(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits, self.probes))

    def _block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        data = self.fetch(*self.place[k])
        data, crc = data[:-4], data[-4:]
        if zlib.crc32(data).to_bytes(4, "little") != crc:
            raise ValueError(f"block {k} damaged")
        at, key = 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            more, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + more]
            at += more
            n, start = _read_varint(data, at)
            yield key, np.frombuffer(data, f"<u{self.width}", n, start)
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.place)):
            yield from self._block(k)

    def ends(self) -> tuple[int | None, int | None]:
        """The first and the last identifier."""
        return id_of(next(self._block(0))[0]), id_of(self.last[-1])

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry with this identifier."""
        key = key_of(doc_id)
        if not self.may_contain(key):
            return []
        out = []
        for k in range(bisect_left(self.last, key), len(self.last)):
            found = [ids for at, ids in self._block(k) if at == key]
            out += found
            if not found or self.last[k] > key:
                break
        return out


@cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # cores belong to tasks
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Code points on which the library's normaliser and pattern agree with Python's, each
#: standing for itself after composition: Latin letters without the four separators that
#: Python takes for blanks and without dotted I.
_BEYOND = re.compile("[^\x00-\x1b\x20-\u012f\u0131-\u02ff]")
#: The pattern of the tokenizers that are cut here (fixed value); no match holds a blank.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Runs whose ids a worker keeps, beyond which it starts anew.
_KEPT = 500_000


class Encoder:
    """``encode`` of a text as the library does, each distinct run between blanks once per worker.

    Holds for tokenizers that compose, fold blanks, lower and cut by a pattern that never
    matches blanks, as checked from their own description; texts with other characters or with an added token's
    string, and other tokenizers, go through the library whole.
    """

    def __init__(self, path: str, width: int):
        import regex

        self.tok, self.kind, self.code, self.ids = _tokenizer(path), f"<u{width}", {2: "H", 4: "I"}[width], {}
        own = json.loads(self.tok.to_str())
        cut = [x for x in (own["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        names = [x["type"] for x in (own["normalizer"] or {}).get("normalizers", [])]
        self.quick = names == ["NFC", "Replace", "Lowercase"] and len(cut) == 1 and cut[0]["behavior"] == "Removed" and cut[0]["invert"]
        self.quick = self.quick and cut[0]["pattern"].get("Regex") == PATTERN
        if self.quick:
            from tokenizers.pre_tokenizers import ByteLevel

            self.find, self.merge = regex.compile(PATTERN).findall, self.tok.model.tokenize
            self.spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
            self.added = [x["content"] for x in own["added_tokens"]]

    def _word(self, word: str) -> bytes:
        # Printable ASCII is spelt as it stands.
        ids = [t.id for t in self.merge(word if word.isascii() and word.isprintable() else self.spell(word)[0][0])]
        self.ids[word] = found = struct.pack(f"<{len(ids)}{self.code}", *ids)
        return found

    def _run(self, run: str) -> bytes:
        if len(self.ids) >= _KEPT:
            self.ids.clear()
        if run.isalpha():
            return self._word(run)
        # A word by itself is cut as it is within a run, so one table serves both.
        self.ids[run] = found = b"".join([self.ids.get(w) or self._word(w) for w in self.find(run)])
        return found

    def __call__(self, text: str) -> np.ndarray:
        if not self.quick or _BEYOND.search(text) or any(a in text for a in self.added):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids).astype(self.kind)
        get, new = self.ids.get, self._run
        return np.frombuffer(b"".join([get(r) or new(r) for r in text.lower().split()]), self.kind)


@cache
def _encoder(path: str, width: int) -> Encoder:
    return Encoder(path, width)


def _width(path: str, end_id: int) -> int:
    return 2 if max(_tokenizer(path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4


def write_shards(docs: DataFrame, place: str, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode ``docs`` and write the shards to the folder ``place``.

    Texts are shuffled once, by range of identifier and text hash (so that one identifier
    on very many rows is dealt over several shards), sorted by these and the text, and
    encoded in that order.  Files close at SHARD_BYTES.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, width = TaskContext.get().partitionId(), 0, _width(path, end_id)
        encode = _encoder(path, width)
        writer = Writer(width, BLOCK_BYTES)

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{made:05d}"]), pa.array([writer.finish()], pa.binary())], ["shard", "content"])

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                writer.add(key_of(key.as_py()), np.append(encode(text.as_py() or ""), end_id))
                if writer.size >= SHARD_BYTES:
                    yield file()
                    made, writer = made + 1, Writer(width, BLOCK_BYTES)
        if writer.keys:
            yield file()
        del writer
        give_back()

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).withColumn("salt", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "salt").sortWithinPartitions("doc_id", "salt", "text").select("doc_id", "text")
    write_files(ordered.mapInArrow(run, "shard string, content binary"), place, ["shard"], "content", MAGIC)


def read_shards(spark: SparkSession, place: str) -> DataFrame:
    """One row per entry, read from the files: shard, ids before it there, number of ids, their CRC-32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0), batch.column(1), strict=True):
                keys, counts, sums = [], [], []
                reader = Reader(content.as_py())
                for key, ids in reader:
                    keys.append(id_of(key))
                    counts.append(len(ids))
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                within = np.cumsum(counts) - counts
                if (len(counts), sum(counts)) != (reader.entries, reader.ids):
                    raise ValueError(f"entries of {shard} differ from its footer")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array([shard.as_py()] * len(keys), pa.string()), pa.array(within), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())],
                    [x.split()[0] for x in _ROWS.split(", ")],
                )

    return read_files(spark, place).select(F.col("shard").cast("string"), "content").mapInArrow(run, _ROWS)


def manifest(spark: SparkSession, place: str) -> DataFrame:
    """(path, part, first_id, last_id) of each shard, from its footer, index and first block; null sorts before all identifiers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = []
            for path in batch.column(0):
                with open_file(path.as_py()) as f:
                    ends.append(Reader(f).ends())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([e[k] for e in ends], pa.int64()) for k in (0, 1))], ["path", "part", "first_id", "last_id"])

    files = spark.read.format("binaryFile").load(place).select("path", F.substring(F.col("shard").cast("string"), 1, 6).cast("int").alias("part"))
    return files.mapInArrow(run, "path string, part int, first_id long, last_id long")


def lookup(ids: DataFrame, place: str, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids): the token ids of every entry with one of the identifiers in ``ids``.

    Identifiers are dealt to the shards whose range they fall into: first to partitions of
    the writing job by bisecting their bounds (one long each, all that the driver holds),
    then to shards by a join on the partition.  Each shard is opened once, of which
    footer, index and Bloom filter are read, and one block for each identifier that may
    be there (more where its entries run over several).  Identifiers that aren't there
    give no row; null ones are looked up like any other; repeated ones count once.  Needs a
    file system that pyarrow can open.
    """
    spark = ids.sparkSession
    shards = scratch_table(manifest(spark, place), "manifest")
    lowest = -(1 << 63)
    bound = lambda c: F.coalesce(c, F.lit(lowest))
    parts = sorted(tuple(r) for r in shards.groupBy("part").agg(F.min(bound(F.col("first_id"))), F.max(bound(F.col("last_id")))).collect())
    names, first, last = (np.array([p[k] for p in parts], np.int64) for k in range(3))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.column(0).fill_null(lowest).to_numpy(zero_copy_only=False)
            a, b = np.searchsorted(last, mine, "left"), np.searchsorted(first, mine, "right")
            n = np.maximum(b - a, 0)
            at = np.repeat(np.arange(len(mine)), n)
            which = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(names[which].astype(np.int32))], ["doc_id", "part"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file, reader = None, None, None
        for batch in batches:
            keys, found = [], []
            for p, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != path:
                    if file is not None:
                        file.close()
                    path, file = p, open_file(p)
                    reader = Reader(file)
                for x in reader.get(key):
                    keys.append(key)
                    found.append(x.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "ids"])
        if file is not None:
            file.close()

    wanted = ids.select(ids[doc_id].cast("long").alias("doc_id")).distinct().mapInArrow(deal, "doc_id long, part int")
    inside = bound(F.col("doc_id")).between(bound(F.col("first_id")), bound(F.col("last_id")))
    aimed = wanted.join(shards, "part").where(inside).select("path", "doc_id")
    return aimed.repartition("path").sortWithinPartitions("path", "doc_id").mapInArrow(read, "doc_id long, ids array<long>")


def token_shards(docs: DataFrame, path: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", place: str | None = None) -> DataFrame:
    """Write ``docs`` as shards, read them back, and return one row per document.

    Columns: doc_id, start (ids of all documents before it), n_tokens (with the closing
    ``end_id``), ids_crc32 (of its ids as little-endian unsigned 32-bit integers), shard.
    Order is ascending doc_id, null first, ties by hash of the text and text.  Null and empty texts hold the
    closing id alone.  An empty table writes no file and gives an empty result.

    ``start`` adds up inside a shard as it is read, over the shards of a partition of the
    writing job, and over these partitions (a row each in one task).
    """
    spark = docs.sparkSession
    place = place or scratch_path(spark, "sstable")
    write_shards(docs, place, path, end_id, doc_id, text)
    if spark.read.format("binaryFile").load(place).select("path").isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")
    entries = scratch_table(read_shards(spark, place), "entries")
    totals = scratch_table(entries.groupBy("shard").agg(F.sum("n_tokens").alias("ids")).withColumn("part", F.substring("shard", 1, 6)), "totals")
    upto = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = totals.groupBy("part").agg(F.sum("ids").alias("ids")).select("part", upto(Window.orderBy("part")).alias("base"))
    ahead = totals.withColumn("own", upto(Window.partitionBy("part").orderBy("shard"))).join(parts, "part").select("shard", (F.col("base") + F.col("own")).alias("ahead"))
    return entries.join(ahead, "shard").select("doc_id", (F.col("ahead") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "shard")

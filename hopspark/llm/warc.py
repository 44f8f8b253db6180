"""WARC archives: written, normalised to one gzip member per record, read back by offset.

Archives often arrive as one gzip stream over a whole file, in which no record can be
reached without inflating all before it.  :func:`normalise` opens such a file as a stream,
inflates it once, rewrites each record as a gzip member of its own in archives of bounded
size, and writes a sidecar index with the offset and length of every member beside each.
What a task holds is a record and an archive of PART_BYTES, however large the file.
:func:`read_pages` takes records out by these offsets.

Files are written by Spark (:func:`hopspark.llm.common.write_files`); each closes with an
empty gzip member, which readers of gzip pass over.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopspark.llm.common import give_back, open_file, opens, read_files, scratch_path, scratch_table, write_files

#: An empty gzip member.
END = gzip.compress(b"", mtime=0)
#: A file closes once its records have this many bytes before compression.
FILE_BYTES = 32_000_000
#: A normalised archive closes once its members have this many bytes.
PART_BYTES = 32_000_000
MIN_REVISIT_BYTES = 1000
#: Shared payloads (some 200 bytes each: digest, length, hash, identifier) up to which they
#: are broadcast; beyond, each is dealt to SALTS tasks, so that none meets all its copies.
BROADCAST_SHARED, SALTS = 200_000, 16
#: Bytes of members that are read at once, and most tasks that read archives.
READ_BYTES, MOST_READERS = 4_000_000, 20_000
#: Where Spark hands files over whole: bytes of sidecar indexes up to which they are broadcast; beyond, archives and indexes meet by a shuffle.
BROADCAST_INDEX = 16_000_000
DATE = "2024-01-01T00:00:00Z"

_FILES = "kind string, file string, content binary"
_PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    name = urn.strip("<>").rpartition(":")[2]
    return None if name == "null" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, n_bytes: int, refers_to: int | None, revisit: bool) -> bytes:
    """A response, or a revisit that holds the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or 'about:blank', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[5:5] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(data: bytes | bytearray, at: int = 0) -> tuple[dict[str, str], int]:
    """Header fields by lower-case name ('' has the first line), and where the block begins."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode("utf-8").split("\r\n")
    out = {"": first}
    for line in lines:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out, end + 4


def decide(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Pages with payload, its digest, and the page they revisit.

    Of equal payloads of ``min_bytes`` or more, the record of the largest page_id is the
    response.  Digests are aggregated before they are joined back, so a payload that a
    third of all pages share is one row on the other side; up to BROADCAST_SHARED such
    rows are sent to every task, so that payloads stay where they are.  Beyond that pages
    are shuffled once, by digest and a salt.  Equality is that of SHA-1, length and a
    second hash.
    """
    full = pages.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.length("payload").cast("long"), "second": F.xxhash64("payload")})
    keys = ["payload_digest", "payload_bytes", "second"]
    shared = full.where(F.col("payload_bytes") >= min_bytes).groupBy(*keys).agg(F.max("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1 AND first_id IS NOT NULL").drop("copies")
    shared = scratch_table(shared, "shared-payloads")
    if shared.count() <= BROADCAST_SHARED:
        return full.join(F.broadcast(shared), keys, "left").drop("second")
    copies = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = full.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return salted.join(copies, [*keys, "salt"], "left").drop("second", "salt")


def write_monolithic(decided: DataFrame, place: str) -> None:
    """WARC files, each a single gzip stream.

    Repeated rows of the largest page_id are all responses; a row of null page_id
    revisits it like any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, raw = TaskContext.get().partitionId(), 0, 0
        deflate, out = zlib.compressobj(1, wbits=31), []

        def file() -> pa.RecordBatch:
            content = b"".join([*out, deflate.flush()])
            return pa.RecordBatch.from_arrays([pa.array(["warc"]), pa.array([f"{part:06d}-{made:05d}"]), pa.array([content], pa.binary())], ["kind", "file", "content"])

        for batch in batches:
            for page_id, url, payload, digest, n, first in zip(*(c for c in batch.columns), strict=True):
                page_id, first = page_id.as_py(), first.as_py()
                data = record(page_id, url.as_py(), payload.as_py(), digest.as_py(), n.as_py(), first, first is not None and page_id != first)
                out.append(deflate.compress(data))
                raw += len(data)
                if raw >= FILE_BYTES:
                    yield file()
                    made, raw, deflate, out = made + 1, 0, zlib.compressobj(1, wbits=31), []
        if raw:
            yield file()

    rows = decided.select("page_id", "url", "payload", "payload_digest", "payload_bytes", "first_id").mapInArrow(run, _FILES)
    write_files(rows, place, ["kind", "file"], "content", END)


def records(stream: bytes | BinaryIO) -> Iterator[bytes]:
    """The records of a gzip file, however many members it has, read and inflated once from front to back; holds one record."""
    inflate, held = zlib.decompressobj(wbits=31), bytearray()
    source = io.BytesIO(stream) if isinstance(stream, bytes) else stream
    pending, inside = b"", False
    while True:
        if inflate.eof:
            pending, inside = inflate.unused_data, False
            inflate = zlib.decompressobj(wbits=31)
        if not pending and not (pending := inflate.unconsumed_tail or source.read(1 << 18)):
            break
        held += inflate.decompress(pending, 1 << 22)
        pending, inside = inflate.unconsumed_tail, True
        begin = 0
        while (end := _record_end(held, begin)) is not None:
            yield bytes(held[begin:end])
            begin = end
        del held[:begin]
    if held.strip() or inside:
        raise ValueError("archive ends inside a record")


def _record_end(data: bytearray, at: int) -> int | None:
    if data.find(b"\r\n\r\n", at) < 0:
        return None
    fields, body = headers(data, at)
    if not fields[""].startswith("WARC/"):
        raise ValueError("no WARC record")
    end = body + int(fields["content-length"]) + 4
    return end if end <= len(data) else None


def normalised(stream: bytes | BinaryIO, level: int = 6, part_bytes: int | None = None) -> Iterator[tuple[bytes, list[tuple[str, int, int]]]]:
    """Archives of one member per record, of ``part_bytes`` or little more, each with its index of (record id, offset, length)."""
    most = part_bytes or PART_BYTES
    out, index, at = [], [], 0
    for data in records(stream):
        member = gzip.compress(data, level, mtime=0)
        index.append((headers(data)[0]["warc-record-id"], at, len(member)))
        out.append(member)
        at += len(member)
        if at >= most:
            yield b"".join(out), index
            out, index, at = [], [], 0
    if out:
        yield b"".join(out), index


def normalise(spark: SparkSession, source: str, place: str, level: int = 6) -> None:
    """Rewrite the archives in ``source`` to ``place``, each as archives of bounded size with a sidecar index (gzipped text).

    Workers open the files themselves, as streams, where pyarrow knows the file system;
    elsewhere Spark hands them over whole, which holds up to two gigabytes.
    """
    streamed = opens(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, given in zip(batch.column(0), batch.column(1), strict=True):
                with open_file(given.as_py(), stream=True) if streamed else io.BytesIO(given.as_py()) as stream:
                    for nth, (archive, index) in enumerate(normalised(stream, level, PART_BYTES)):
                        sidecar = gzip.compress("".join(f"{urn} {a} {n}\n" for urn, a, n in index).encode(), mtime=0)
                        for kind, data in (("warc", archive), ("index", sidecar)):
                            yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([f"{file.as_py()}-{nth:05d}"]), pa.array([data], pa.binary())], ["kind", "file", "content"])
        give_back()

    files = read_files(spark, source).where("kind = 'warc'").select(F.col("file").cast("string"), "path" if streamed else "content")
    write_files(files.mapInArrow(run, _FILES), place, ["kind", "file"], "content", END)


def _fetched(lines: list[tuple[str, int, int]], fetch: Callable[[int, int], bytes]) -> Iterator[tuple[str, int, int, bytes]]:
    """Each record of an index, ``fetch(offset, length)`` being asked for members that lie side by side up to READ_BYTES at once."""
    at = 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and lines[end][1] == lines[at][1] + size and (end == at or size + lines[end][2] <= READ_BYTES):
            size += lines[end][2]
            end += 1
        data, begin = fetch(lines[at][1], size), lines[at][1]
        for urn, a, n in lines[at:end]:
            yield urn, a, n, gzip.decompress(data[a - begin : a - begin + n])
        at = end


def _page_rows(file: str, lines: list[tuple[str, int, int]], fetch: Callable[[int, int], bytes]) -> pa.RecordBatch:
    """The rows of an archive, by its index."""
    rows = []
    for urn, a, n, data in _fetched(lines, fetch):
        warc, body = headers(data)
        http, payload = headers(data, body)
        if warc["warc-record-id"] != urn:
            raise ValueError(f"index of {file} points at another record")
        size, digest, revisit = int(http["content-length"]), warc["warc-payload-digest"].removeprefix("sha1:"), warc["warc-type"] == "revisit"
        if not revisit:
            content = data[payload : body + int(warc["content-length"])]
            if (len(content), hashlib.sha1(content).hexdigest()) != (size, digest):
                raise ValueError(f"payload of {urn} is damaged")
        rows.append((_page_of(urn), size, digest, warc["warc-type"], _page_of(warc["warc-refers-to"]) if revisit else None, file, a, n))
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [x.split()[0] for x in _PAGES.split(", ")])


def _lines(sidecar: bytes) -> list[tuple[str, int, int]]:
    parts = (line.split(" ") for line in gzip.decompress(sidecar).decode().splitlines())
    return [(urn, int(a), int(n)) for urn, a, n in parts]


def read_pages(spark: SparkSession, place: str) -> DataFrame:
    """One row per record, taken out of its archive by the offset in the sidecar index.

    The payload of a response is digested anew and must match its header.  Tasks are given
    the paths of an archive and its index, open both, and read members by range; where
    pyarrow doesn't know the file system, Spark hands both over whole.
    """
    files = read_files(spark, place).select("kind", F.col("file").cast("string").alias("file"), "length", "path", "content")
    archives, indexes = files.where("kind = 'warc'"), files.where("kind = 'index'")
    if opens(place):

        def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for file, archive, sidecar in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    with open_file(sidecar) as f:
                        lines = _lines(f.read())
                    with open_file(archive) as f:
                        yield _page_rows(file, lines, lambda a, n, f=f: f.read_at(n, a))
            give_back()

        # only paths meet; a pair of files is then dealt to any task
        pairs = archives.select("file", F.col("path").alias("archive")).join(indexes.select("file", F.col("path").alias("sidecar")), "file")
        tasks = max(1, archives.select("path").count())
        return pairs.repartition(min(tasks, MOST_READERS), "file").select("file", "archive", "sidecar").mapInArrow(by_range, _PAGES)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, archive, sidecar in zip(*(c for c in batch.columns), strict=True):
                held = archive.as_py()
                yield _page_rows(file.as_py(), _lines(sidecar.as_py()), lambda a, n, held=held: held[a : a + n])
        give_back()

    few = (indexes.agg(F.sum("length")).first()[0] or 0) <= BROADCAST_INDEX  # lengths come from the listing
    sidecars = indexes.select("file", F.col("content").alias("sidecar"))
    return archives.select("file", F.col("content").alias("archive")).join(F.broadcast(sidecars) if few else sidecars, "file").select("file", "archive", "sidecar").mapInArrow(whole, _PAGES)


def archive_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", place: str | None = None) -> DataFrame:
    """Write ``pages`` as whole-file gzip WARCs, normalise these, and read the result back.

    One row per row of ``pages``: page_id, payload_bytes and payload_digest (bare SHA-1) of
    the full payload, record_type, refers_to (of revisits), and where the record stands.
    The payload is the html in UTF-8, empty for null.  Payloads under MIN_REVISIT_BYTES
    are never revisits.  Repeated rows give records each; rows that share the largest
    page_id of a payload are all responses.  An empty table writes no file.
    """
    spark = pages.sparkSession
    place = place or scratch_path(spark, "warc")
    rows = pages.select(pages[page_id].cast("long").alias("page_id"), pages[url].alias("url"), F.coalesce(pages[html], F.lit("")).cast("binary").alias("payload"))
    write_monolithic(decide(rows), f"{place}/monolithic")
    if spark.read.format("binaryFile").load(f"{place}/monolithic").select("path").isEmpty():
        return spark.createDataFrame([], _PAGES)
    normalise(spark, f"{place}/monolithic", f"{place}/records")
    return read_pages(spark, f"{place}/records")

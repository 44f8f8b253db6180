import gzip
import hashlib
import random

import pytest

from hopspark.llm import warc
from hopspark.llm.queries import ORACLE_SQL, QUERIES
from oracle import assert_same

PAGES = "page_id long, url string, html string, payload string, file string, first_id long"


def test_query_equals_its_sql(spark):
    assert_same(spark, QUERIES["op5_warc_normaliser"], ORACLE_SQL["op5_warc_normaliser"])


def archived(df):
    return {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(df).collect()}


def test_revisits_and_odd_pages(spark):
    big, small = "é" * 500, "é" * 499
    rows = [(1, "http://a/ä b\r\nX: y", big), (2, None, big), (9, "u", big), (3, "u", small), (4, "u", small), (5, "u", None), (6, "u", "")]
    df = spark.createDataFrame([(*r, "clash", "clash", 7) for r in rows], PAGES)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = {k: (len((t or "").encode()), sha(t), "revisit" if k in (1, 2) else "response", 9 if k in (1, 2) else None) for k, _, t in rows}
    assert archived(df) == want


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_SHARED", 0)
    monkeypatch.setattr(warc, "BROADCAST_INDEX", 0)
    df = spark.createDataFrame([(k, "u", "x" * 1000 * (k % 3 + 1)) for k in range(30)], "page_id long, url string, html string")
    got = archived(df)
    assert {k: v[3] for k, v in got.items()} == {k: None if k > 26 else 27 + k % 3 for k in range(30)}


@pytest.mark.parametrize("index_bytes", [0, 1 << 30])
def test_files_that_spark_hands_over_whole_give_the_same(spark, monkeypatch, index_bytes):
    monkeypatch.setattr(warc, "opens", lambda place: False)
    monkeypatch.setattr(warc, "BROADCAST_INDEX", index_bytes)
    df = spark.createDataFrame([(k, "u", "x" * 1000 * (k % 3 + 1)) for k in range(30)], "page_id long, url string, html string")
    assert {k: v[3] for k, v in archived(df).items()} == {k: None if k > 26 else 27 + k % 3 for k in range(30)}


def test_only_paths_of_archives_are_dealt_to_readers(spark, tmp_path):
    df = spark.createDataFrame([(k, "u", f"{k}" * 500) for k in range(50)], "page_id long, url string, html string")
    got = warc.archive_pages(df, place=str(tmp_path / "w"))
    assert "content" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 50


def test_neighbouring_members_are_read_together(monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 100)
    members = [gzip.compress(bytes([k]) * 3, mtime=0) for k in range(9)]
    at, lines = 0, []
    for k, m in enumerate(members):
        lines.append((f"u{k}", at, len(m)))
        at += len(m) + (50 if k == 4 else 0)
    held = b"".join(m + (b"?" * 50 if k == 4 else b"") for k, m in enumerate(members))
    asked = []
    got = list(warc._fetched(lines, lambda a, n: asked.append((a, n)) or held[a : a + n]))
    assert [d for *_, d in got] == [bytes([k]) * 3 for k in range(9)]
    assert len(asked) < 9 and sum(n for _, n in asked) == sum(map(len, members)) and all(n <= 100 for _, n in asked)


def test_repeated_and_null_ids(spark):
    big = "x" * 2000
    df = spark.createDataFrame([(1, "u", big), (7, "u", big), (7, "u", big), (None, "u", big)], "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in warc.archive_pages(df).collect())
    assert got == [(0, "revisit", 7), (1, "revisit", 7), (7, "response", 0), (7, "response", 0)]


def test_no_pages(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def whole(n=50):
    rng = random.Random(n)
    return [warc.record(k, "u", rng.randbytes(rng.choice([0, 10, 70_000])), "d", 0, None, False) for k in range(n)]


@pytest.mark.parametrize("pieces", [1, 3, 50])
def test_streams_of_any_number_of_members(pieces):
    records = whole()
    step = -(-len(records) // pieces)
    stream = b"".join(gzip.compress(b"".join(records[a : a + step])) for a in range(0, len(records), step)) + warc.END
    assert list(warc.records(stream)) == records


def test_each_record_opens_by_its_offset():
    records = whole(20)
    [(archive, index)] = warc.normalised(gzip.compress(b"".join(records)))
    assert [gzip.decompress(archive[a : a + n]) for _, a, n in index] == records
    assert gzip.decompress(archive + warc.END) == b"".join(records)


def test_archives_close_at_their_size():
    records = whole(40)
    parts = list(warc.normalised(gzip.compress(b"".join(records)), part_bytes=100_000))
    assert len(parts) > 3 and [gzip.decompress(x[a : a + n]) for x, index in parts for _, a, n in index] == records
    assert max(len(x) for x, _ in parts) < 100_000 + 80_000


def test_archives_far_above_what_a_task_holds(spark, tmp_path, monkeypatch):
    """One gzip stream of 600 MB; the peak memory of a process that normalises it grows by far less."""
    import subprocess
    import sys

    path = tmp_path / "kind=warc" / "file=big"
    path.mkdir(parents=True)
    page = random.Random(1).randbytes(150_000).hex().encode()
    n = 2000
    with gzip.open(path / "part-0.txt", "wb", compresslevel=1) as f:
        for k in range(n):
            f.write(warc.record(k, "u", page, hashlib.sha1(page).hexdigest(), len(page), None, False))
    code = (
        "import resource, sys; from hopspark.llm import warc; from hopspark.llm.common import open_file\n"
        "warc.normalised.__kwdefaults__; before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        f"n = sum(len(index) for _, index in warc.normalised(open_file({str(path / 'part-0.txt')!r}, stream=True), 1))\n"
        "print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    count, mb = map(int, done.stdout.split())
    assert count == n and mb < 150


def test_cut_streams_are_errors():
    stream = gzip.compress(b"".join(whole(5)))
    with pytest.raises(ValueError):
        list(warc.records(stream[:-40]))
    with pytest.raises(ValueError):
        list(warc.records(gzip.compress(b"".join(whole(5))[:-10])))


def test_small_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 50_000)
    monkeypatch.setattr(warc, "PART_BYTES", 200)
    df = spark.createDataFrame([(k, "u", f"{k} " * 600) for k in range(60)], "page_id long, url string, html string")
    got = warc.archive_pages(df)
    assert got.select("file").distinct().count() > 5 and got.count() == 60

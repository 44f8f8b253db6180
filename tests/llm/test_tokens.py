import base64
import gzip
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from hopspark.llm import blocks, bpe, sstable, token_counts
from hopspark.llm.queries import BYTE_BPE, MULTI_RANKS, WORD_BPE

SF = "/root/testdata/sf0.001"
BYTES, WORDS = Tokenizer.from_file(BYTE_BPE), Tokenizer.from_file(WORD_BPE)
with open(MULTI_RANKS, "rb") as f:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
MULTI = tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def expected_counts(rows):
    out = []
    for k, t in rows:
        n = len(BYTES.encode(t, add_special_tokens=False).ids)
        out.append((k, len(t.encode()), n, n > 512))
    return sorted(out, key=repr)


def test_counts_equal_the_library(documents, odd, odd_rows):
    for df, rows in ((documents, texts(documents)), (odd, odd_rows)):
        got = token_counts.token_counts(df, BYTE_BPE).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
        assert sorted(map(tuple, got), key=repr) == expected_counts(rows)


def expected_ids(rows):
    out = []
    for k, t in rows:
        ids = MULTI.encode_ordinary(t)
        out.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_bpe_equals_the_library_and_decodes(documents, odd, odd_rows):
    for df, rows in ((documents, texts(documents)), (odd, odd_rows)):
        got = bpe.bpe_round_trip(df, MULTI_RANKS, P.PATTERN).collect()
        assert sorted(map(tuple, got), key=repr) == expected_ids(rows)


def test_bpe_gives_ids(odd, odd_rows):
    got = bpe.bpe_round_trip(odd, MULTI_RANKS, P.PATTERN, with_ids=True).select("doc_id", "ids").collect()
    assert sorted(map(repr, ((r.doc_id, list(r.ids)) for r in got))) == sorted(repr((k, MULTI.encode_ordinary(t))) for k, t in odd_rows)


def test_many_small_blocks_give_the_same(documents, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_WORDS", 50)
    got = bpe.bpe_round_trip(documents, MULTI_RANKS, P.PATTERN).collect()
    assert sorted(map(tuple, got), key=repr) == expected_ids(texts(documents))


def test_a_full_dictionary_starts_anew(documents, monkeypatch):
    monkeypatch.setattr(blocks, "KEPT_WORDS", 20)
    monkeypatch.setattr(blocks, "BLOCK_WORDS", 500)
    got = bpe.bpe_round_trip(documents, MULTI_RANKS, P.PATTERN).collect()
    assert sorted(map(tuple, got), key=repr) == expected_ids(texts(documents))


def test_no_table_stays_in_the_catalog(spark, documents):
    token_counts.token_counts(documents, BYTE_BPE).collect()
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("hopspark")] == []


def test_empty_tables(none):
    assert token_counts.token_counts(none, BYTE_BPE).collect() == []
    assert bpe.bpe_round_trip(none, MULTI_RANKS, P.PATTERN).collect() == []
    assert sstable.token_shards(none, WORD_BPE).collect() == []


def strings():
    rng = random.Random(4)
    letters = [chr(c) for c in [*range(32, 127), 9, 10, 0xC4, 0xE9, 0x131, 0x130, 0x3A3, 0x3C3, 0x416, 0x5D0, 0x6F22, 0x1F600, 0x301, 0x1C, 0x85, 0xA0, 0x2003, 0x212A, 0x17F]]
    for _ in range(400):
        yield "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
    yield from ("a<|endoftext|>b", "<|startoftext|>", "<|ENDOFTEXT|>", "it's WE'LL 'S", "   x  ")


def test_cutting_agrees_with_the_library():
    cut, count = token_counts.cutter(BYTE_BPE), token_counts.piece_counter(BYTE_BPE)
    encode = sstable.Encoder(WORD_BPE, 2)
    for t in strings():
        assert sum(count(w)[0] for w in cut(t)) == len(BYTES.encode(t, add_special_tokens=False).ids), t
        assert encode(t).tolist() == WORDS.encode(t, add_special_tokens=False).ids, t


def test_quick_characters_agree_one_by_one():
    encode = sstable.Encoder(WORD_BPE, 2)
    for c in range(0x300):
        t = f"A{chr(c)}b {chr(c)}1{chr(c)}"
        assert encode(t).tolist() == WORDS.encode(t, add_special_tokens=False).ids, hex(c)
    cut, count = token_counts.cutter(BYTE_BPE), token_counts.piece_counter(BYTE_BPE)
    for c in range(0x558):
        t = f"A{chr(c)}b {chr(c)}1{chr(c)}  {chr(c)}"
        assert sum(count(w)[0] for w in cut(t)) == len(BYTES.encode(t, add_special_tokens=False).ids), hex(c)


def shard_rows(df):
    return [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.orderBy("start").collect()]


def expected_shards(rows):
    out, start = [], 0
    for k, t in rows:
        ids = [*WORDS.encode(t, add_special_tokens=False).ids, 2]
        out.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_shards_hold_all_ids_in_order(documents):
    assert shard_rows(sstable.token_shards(documents, WORD_BPE)) == expected_shards(sorted(texts(documents)))


def test_shards_of_odd_rows(odd, odd_rows):
    got = shard_rows(sstable.token_shards(odd, WORD_BPE))
    assert [r[0] for r in got] == sorted((k for k, _ in odd_rows), key=lambda k: (k is not None, k or 0))
    sizes = sorted((k, n) for k, _, n, _ in expected_shards(odd_rows) if k is not None)
    assert sorted((k, n) for k, _, n, _ in got if k is not None) == sizes
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False))


def test_small_files_and_blocks(documents, monkeypatch):
    monkeypatch.setattr(sstable, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 1_000)
    got = sstable.token_shards(documents, WORD_BPE)
    assert got.select("shard").distinct().count() > 4
    assert shard_rows(got) == expected_shards(sorted(texts(documents)))


def table(keys, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 200)
    w = sstable.Writer(2)
    for k in keys:
        w.add(sstable.key_of(k), np.array([(k or 0) & 0xFFFF, 2]))
    return sstable.Reader(w.finish() + sstable.MAGIC)


def test_lookup(monkeypatch):
    rng = random.Random(2)
    keys = sorted({rng.randrange(-(1 << 63), 1 << 63) for _ in range(500)})
    r = table([None, *keys], monkeypatch)
    assert len(r.place) > 10
    for k in [None, *keys]:
        assert [x.tolist() for x in r.get(k)] == [[(k or 0) & 0xFFFF, 2]]
    absent = [k + 1 for k in keys if k + 1 not in set(keys)]
    assert not any(r.get(k) for k in absent)
    assert sum(r.may_contain(sstable.key_of(k)) for k in absent) < 0.05 * len(absent)


def test_repeated_keys_across_blocks(monkeypatch):
    r = table([1] * 100 + [2], monkeypatch)
    assert (len(r.get(1)), len(r.get(2)), len(r.get(3))) == (100, 1, 0)


def test_damage_is_noticed(monkeypatch):
    r = table(range(50), monkeypatch)
    data = bytearray(r.fetch(0, 1 << 30))
    data[5] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(sstable.Reader(bytes(data)))
    with pytest.raises(ValueError):
        sstable.Reader(gzip.compress(b"no table"))


def test_packing():
    a = np.array([0, 1, 2**32 - 1, 300], np.uint32)
    assert (blocks.unpack(blocks.pack(a)) == a).all()
    assert blocks.unpack_ids(blocks.pack_ids([None, -5, 1 << 62]), 3) == [None, -5, 1 << 62]


def test_lookup_over_files(spark, odd, odd_rows, tmp_path, monkeypatch):
    """Identifiers there and not there, null, repeated, and spread over many shards."""
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 300)
    monkeypatch.setattr(sstable, "SHARD_BYTES", 1500)
    place = str(tmp_path / "shards")
    more = [(k, f"text {k} " * (k % 40)) for k in range(100, 400)] + [(250, "again " * 300)] * 3
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    sstable.write_shards(docs, place, WORD_BPE, 2)
    assert sstable.manifest(spark, place).count() > 20
    asked = [1, 6, None, -7, 250, 250, 399, 77, 10**12, -(10**12)]
    got = sstable.lookup(spark.createDataFrame([(k, "x") for k in asked], "doc_id long, part string"), place)
    want = [(k, [*WORDS.encode(t, add_special_tokens=False).ids, 2]) for k, t in odd_rows + more if k in asked]
    assert sorted(map(repr, ((r.doc_id, list(r.ids)) for r in got.collect()))) == sorted(map(repr, want))

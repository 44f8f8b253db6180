import hashlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from hopspark.llm import alignment
from hopspark.llm.queries import BYTE_BPE, PIECE_BPE

SF = "/root/testdata/sf0.001"
A = Tokenizer.from_file(BYTE_BPE)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
LETTERS = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_OF = {chr(b): b for b in LETTERS} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in LETTERS)}


def bytes_of_b(k):
    piece = B.id_to_piece(k)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(k) else piece.replace("▁", " ").encode()


def expected(rows):
    """The contract in plain Python, the libraries given whole texts."""
    cut, pairs = [], Counter()
    for key, text in rows:
        a = A.encode(" " + text, add_special_tokens=False).ids if text else []
        b = B.encode(text) if text else []
        parts_a, parts_b = [bytes(BYTE_OF[c] for c in A.id_to_token(k)) for k in a], [bytes_of_b(k) for k in b]
        if text and not b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode():
            a, b, parts_a, parts_b = [], [], [], []
        ends = []
        for ids, parts in ((a, parts_a), (b, parts_b)):
            at, out = 0, {}
            for k, part in zip(ids, parts, strict=True):
                at += len(part)
                out[at] = k
            ends.append(out)
        links = [(ends[0][e], ends[1][e]) for e in sorted(ends[0].keys() & ends[1].keys())]
        common, groups, now = ends[0].keys() & ends[1].keys(), [], ([], [])
        for e in sorted(ends[0].keys() | ends[1].keys()):
            for side, into in zip(ends, now, strict=True):
                into += [str(side[e])] if e in side else []
            if e in common:
                groups.append("|".join(map(",".join, now)))
                now = ([], [])
        pairs.update(links)
        cut.append((key, len(a), len(b), groups, links))
    best = defaultdict(int)
    for (_, b), n in pairs.items():
        best[b] = max(best[b], n)
    out = []
    for key, n_a, n_b, groups, links in cut:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else ""
        out.append((key, n_a, n_b, len(groups), len(links), sum(pairs[x] == best[x[1]] for x in links), sum(pairs[x] for x in links), digest))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, alignment.align_tokenizers(df, BYTE_BPE, PIECE_BPE).collect()), key=repr)


ODD = ["", " ", "  ", "a", "a ", " a", "a  b   c ", "x▁y", "▁", "café café", "\n\n\t x\r\n", "<s> </s> <unk> <0x41> <|endoftext|>", " x 　y", "123 4567.89", "漢字\U0001f600\U0001f468‍\U0001f469", "\x00 \x01", "the the the the", "don't I'll we've", "� ﻿"]


@pytest.fixture(scope="module")
def odd_texts(spark):
    rows = [(k % 7 or None, t) for k, t in enumerate([*ODD, *ODD, None, None])]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def rows_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def test_equals_the_libraries_on_whole_texts(spark, odd, odd_rows, odd_texts):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    for df, rows in ((documents, rows_of(documents)), (odd, odd_rows), (odd_texts, rows_of(odd_texts))):
        assert got(df) == expected(rows)


def test_small_blocks_salts_and_dictionaries_give_the_same(spark, odd_texts, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd_texts).repartition(5).cache()
    for name, value in (("BLOCK_CHARS", 20_000), ("GO_CHARS", 3_000), ("SALT_BYTES", 2_000)):
        monkeypatch.setattr(alignment, name, value)
    assert got(df) == expected(rows_of(df))


def test_a_dictionary_starts_anew(monkeypatch):
    monkeypatch.setattr(alignment, "KEPT_BYTES", 300)
    sides = alignment._sides(BYTE_BPE, PIECE_BPE)
    for k in range(20):
        text = f"some words{k} and more {k * 'x'}"
        counts, digests, *_ = alignment._aligned([text], sides)
        assert (int(counts["n_a"][0]), digests[0]) == (expected([(0, text)])[0][1], expected([(0, text)])[0][7])


def test_a_bounded_number_of_texts_makes_a_block(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_DOCS", 3)
    df = spark.createDataFrame([(k, "one two three " * (k % 3)) for k in range(20)], "doc_id long, text string")
    assert got(df) == expected(rows_of(df))


def test_an_empty_table_gives_an_empty_one(none):
    assert got(none) == []


def test_texts_are_cut_only_where_a_blank_follows_something():
    assert alignment._sides(BYTE_BPE, PIECE_BPE).b.cut(" a  b ") == [" a", "  b", " "]


def test_both_libraries_agree_on_every_code_point_that_the_quicker_one_gets():
    side = alignment._sides(BYTE_BPE, PIECE_BPE).a
    for k in range(0x558):
        c = chr(k)
        for text in (f"a{c}b {c}{c} 1{c}2", f"{c} {c}.{c}", f"x  {c}  y{c}"):
            assert side.quick(" " + text, disallowed_special=()).tolist() == A.encode(" " + text, add_special_tokens=False).ids, (k, text)

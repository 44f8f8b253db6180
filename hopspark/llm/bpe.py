"""Byte-level BPE by rank files: each distinct pre-token is merged once for the whole corpus.

Texts become sequences of dictionary positions (:mod:`hopspark.llm.blocks`), distinct
pre-tokens are shuffled by hash and encoded once, ids are joined back to each block and
put together by position.  Decoding looks every id up in the table of token bytes, which
holds one entry per id of the vocabulary and is read by each worker from the rank file.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from hopspark.llm.blocks import Texts, reassemble, resolve, text_blocks

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@cache
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id."""
    table = ranks(path)
    out = [b""] * (max(table.values(), default=-1) + 1)
    for token, rank in table.items():
        out[rank] = token
    return out


@cache
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


def cutter(pattern: str) -> Callable[[str], Iterable[str]]:
    import regex

    return regex.compile(pattern).findall


def encoder(path: str, pattern: str) -> Callable[[str], list[int]]:
    return _encoding(path, pattern).encode_ordinary


def decode(ids: list[int], path: str) -> bytes:
    return b"".join(map(token_bytes(path).__getitem__, ids))


@cache
def _decimals(path: str) -> list[str]:
    return [str(k) for k in range(len(token_bytes(path)))]


def _rows(path: str, with_ids: bool) -> Callable[[Texts], pa.Table]:
    def rows(texts: Texts) -> pa.Table:
        decimals = _decimals(path)
        counts, hashes, decoded, lists = [], [], [], []
        for k in range(len(texts.ids)):
            ids = texts.values(k)
            plain = ids.tolist()
            counts.append(len(plain))
            hashes.append(hashlib.sha256(",".join(map(decimals.__getitem__, plain)).encode()).hexdigest())
            decoded.append(hashlib.sha256(decode(plain, path)).hexdigest())
            if with_ids:
                lists.append(ids.astype("<i4"))
        cols = [pa.array(texts.ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            cols.append(pa.array(lists, pa.list_(pa.int32())))
            names.append("ids")
        return pa.table(cols, names)

    return rows


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: number of tokens, digest of the ids, digest of what they decode to.

    ``path``: a rank file; ``pattern``: what cuts a text into pre-tokens.  Ids are those
    of ``tiktoken`` without special tokens.  With ``with_ids`` the ids come along.  Null
    and empty texts have none (both digests are that of the empty string).  Repeated rows
    and null ids are encoded like any other; other columns are ignored.
    """
    blocks = text_blocks(docs, lambda: cutter(pattern), False, doc_id, text)
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    return reassemble(blocks, resolve(blocks, lambda: encoder(path, pattern)), lambda: _rows(path, with_ids), schema)

"""Token counts: pieces are counted once per distinct pre-token and summed by frequency.

A text is kept as its distinct pre-tokens and how often each occurs
(:mod:`hopspark.llm.blocks`), every distinct pre-token of the corpus is split into pieces
once, and a text's count is the sum of frequency times pieces.  No text's token ids are
ever made.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hopspark.llm.blocks import Texts, reassemble, resolve, text_blocks

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_distinct_pretokens long"


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _special(path: str) -> tuple[re.Pattern | None, frozenset[str]]:
    """A pattern for the added tokens that the library takes out of a text first.

    Holds for added tokens that are matched as they stand (not normalised, no stripping,
    not bound to words), as in the files this is used with; others are refused.
    """
    added = _tokenizer(path).get_added_tokens_decoder().values()
    if any(a.normalized or a.lstrip or a.rstrip or a.single_word for a in added):
        raise ValueError("added tokens that aren't matched literally")
    names = sorted((a.content for a in added), key=len, reverse=True)
    return (re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None), frozenset(names)


#: The pattern of byte-level pre-tokenisers that split by themselves (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Beyond these code points the library and ``regex`` may know different letters.
_BEYOND = re.compile("[^\x00-\u0557]")


def cutter(path: str) -> Callable[[str], Iterable[str]]:
    """Pre-tokens of a text as the library cuts it, added tokens set apart by a leading NUL.

    Texts within the code points on which both agree are cut by ``regex``, which is
    quicker; others by the library itself.  A pre-token can't look like an added token
    set apart, as no pre-token holds an added token's whole string.
    """
    import regex

    tok = _tokenizer(path)
    special, names = _special(path)
    own = json.loads(tok.to_str())
    if own["normalizer"] is not None or own["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
        raise ValueError("not a byte-level tokenizer without normaliser")
    split, find = tok.pre_tokenizer.pre_tokenize_str, regex.compile(PATTERN).findall

    def plain(text: str) -> list[str]:
        if _BEYOND.search(text) is None:
            return find(text)
        return [text[a:b] for _, (a, b) in split(text)]

    def cut(text: str) -> list[str]:
        if special is None or not any(n in text for n in names):
            return plain(text)
        out: list[str] = []
        for part in special.split(text):
            if part in names:
                out.append("\0" + part)
            elif part:
                out += plain(part)
        return out

    return cut


def piece_counter(path: str) -> Callable[[str], list[int]]:
    from tokenizers.pre_tokenizers import ByteLevel

    model, names = _tokenizer(path).model, _special(path)[1]
    spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
    return lambda word: [1] if word[0] == "\0" and word[1:] in names else [len(model.tokenize(spell(word)[0][0]))]


def _rows(limit: int) -> Callable[[Texts], pa.Table]:
    def rows(texts: Texts) -> pa.Table:
        pieces = texts.flat[texts.start].astype(np.int64) if len(texts.start) else np.zeros(0, np.int64)
        per = pieces[texts.codes] * texts.freqs
        sums = np.concatenate([[0], np.cumsum(per)])
        n = sums[texts.bounds[1:]] - sums[texts.bounds[:-1]]
        return pa.table(
            [pa.array(texts.ids, pa.int64()), pa.array(texts.sizes.astype(np.int64)), pa.array(n), pa.array(n > limit), pa.array(np.diff(texts.bounds))],
            [x.split()[0] for x in SCHEMA.split(", ")],
        )

    return rows


def token_counts(docs: DataFrame, path: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: bytes, tokens, and whether these are more than ``limit``.

    ``path``: a byte-level ``tokenizers`` file without a normaliser; counts are those of
    ``encode(text, add_special_tokens=False)`` there.  Null and empty texts have 0 of
    both.  Repeated rows and null ids are counted like any other; other columns are
    ignored; an empty table gives an empty one.
    """
    blocks = text_blocks(docs, lambda: cutter(path), True, doc_id, text)
    return reassemble(blocks, resolve(blocks, lambda: piece_counter(path)), lambda: _rows(limit), SCHEMA)

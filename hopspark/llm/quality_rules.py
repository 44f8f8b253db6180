"""Quality rules: how much of a text lies inside repeated lines and word n-grams.

Each text is hashed word by word; the hash of an n-gram is rolled from that of the
(n-1)-gram before it (``H[n][i] = H[n-1][i] * B + h[i+n-1]`` modulo 2**64), so that all
lengths together cost one pass of numpy per length.  Positions of n-grams that occur
more than once are turned into word coverage by a difference array, and coverage into
characters.  No shuffle: a text is judged by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hopspark.llm.common import slices, text_bytes

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_chars long, dup_ngram_chars array<long>"
)

#: Lengths of the n-grams whose coverage the verdict looks at.
LENGTHS = (5, 6, 7, 8, 9, 10)
#: A text fails when more than this share of its word characters lies in repeated n-grams
#: of any of LENGTHS, or in repeated lines: the share of words that the base rule allows.
MAX_NGRAM_SHARE = 0.30
MAX_LINE_SHARE = 0.30

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\x0b\x0c\r"


def _chars(data: bytes) -> int:
    """Code points in UTF-8 bytes."""
    return len(data.decode("utf-8", "replace"))


def repeated(hashes: np.ndarray) -> np.ndarray:
    """Which positions hold a value that occurs more than once."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    out = np.zeros(len(hashes), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which of ``words`` words lie in a window of ``n`` that begins at a true position of ``starts``."""
    at = np.flatnonzero(starts)
    depth = np.bincount(at, minlength=words + 1)[: words + 1].astype(np.int64)
    depth -= np.bincount(at + n, minlength=words + 1)[: words + 1]
    return np.cumsum(depth)[:words] > 0


def measure(data: bytes, lengths: tuple[int, ...] = LENGTHS, window: int = 8) -> dict:
    """The counts for one text in UTF-8; see :func:`quality_rules` for their meaning."""
    words = data.split()  # on the six ASCII blanks only
    n = len(words)
    lines = data.split(b"\n")
    seen: set[bytes] = set()
    dup_lines = dup_line_chars = 0
    for line in lines:
        if parts := line.split():
            if line in seen:
                dup_lines += 1
                dup_line_chars += sum(map(_chars, parts))
            else:
                seen.add(line)
    out = {
        "n_words": n,
        "word_chars": _chars(data) - sum(data.count(c) for c in _BLANKS),
        "n_symbols": sum(data.count(c) for c in _SYMBOLS),
        "n_dup_lines": dup_lines,
        "n_repeat_words": 0,
        "dup_line_chars": dup_line_chars,
        "dup_ngram_chars": [0] * len(lengths),
    }
    if n <= min(*lengths, window):
        return out
    base = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    sizes = None
    rolled = base
    for length in range(2, max(*lengths, window) + 1):
        if length > n:
            break
        rolled = rolled[:-1] * _BASE + base[length - 1 :]
        if length in lengths or length == window:
            again = repeated(rolled)
            if not again.any():
                break  # a longer n-gram repeats only if its beginning does
            inside = covered(again, length, n)
            if length == window:
                out["n_repeat_words"] = int(inside.sum())
            if length in lengths:
                if sizes is None:
                    sizes = np.fromiter(map(_chars, words), np.int64, n)
                out["dup_ngram_chars"][lengths.index(length)] = int(sizes[inside].sum())
    return out


def verdict(m: dict) -> tuple[bool, bool]:
    """(base_failed, kept) for the counts of :func:`measure`."""
    failed = m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"]
    heavy = m["dup_line_chars"] > MAX_LINE_SHARE * m["word_chars"] or max(m["dup_ngram_chars"]) > MAX_NGRAM_SHARE * m["word_chars"]
    return failed, not failed and not heavy


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in slices(batches):
        cols: dict[str, list] = {k: [] for k in names}
        cols["doc_id"] = batch.column(0)
        for data in batch.column(1):
            m = measure(data.as_py() or b"")
            m["base_failed"], m["kept"] = verdict(m)
            for k in names[1:]:
                cols[k].append(m[k])
        types = {"base_failed": pa.bool_(), "kept": pa.bool_(), "dup_ngram_chars": pa.list_(pa.int64())}
        yield pa.RecordBatch.from_arrays([cols["doc_id"], *(pa.array(cols[k], types.get(k, pa.int64())) for k in names[1:])], names)


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs`` with its counts and verdict.

    Words are runs of anything but the six ASCII blanks; ``word_chars`` counts code
    points in words, ``n_symbols`` the characters ``# * $ % & | < >``, ``n_dup_lines``
    lines with a word that equal an earlier line, ``n_repeat_words`` words inside 8-word
    windows found twice or more.  ``dup_ngram_chars`` has, for each of LENGTHS, the
    characters of words inside n-grams found twice or more; ``dup_line_chars`` those in
    ``n_dup_lines``.  ``base_failed`` rests on the first counts alone; ``kept`` also
    needs both coverages to stay within their shares.

    Null and empty texts have no words: all counts 0, base_failed, not kept.  Repeated
    rows and null ids are judged like any other; other columns are ignored.
    """
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), text_bytes(text).alias("data")).mapInArrow(_judge, SCHEMA)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, all columns; judged where they are read, without a shuffle."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array([verdict(measure((x.as_py() or "").encode()))[1] for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


_WORDS = "[^\\x20\\x09-\\x0D]+"
#: The same in DuckDB, n-grams as texts instead of hashes; shares as stated above.
QUALITY_SQL = f"""
    WITH texts AS (SELECT row_number() OVER () AS t, doc_id, coalesce(text, '') AS text FROM documents),
    cut AS (SELECT t, regexp_extract_all(text, '{_WORDS}') AS w FROM texts),
    words AS (SELECT t, unnest(w) AS word, generate_subscripts(w, 1) AS spot FROM cut),
    per_text AS (SELECT t, count(*) AS n_words, sum(length(word)) AS word_chars FROM words GROUP BY t),
    ahead AS (SELECT t, spot, word, {", ".join(f"lead(word, {k}) OVER w AS w{k}" for k in range(1, 10))} FROM words WINDOW w AS (PARTITION BY t ORDER BY spot)),
    spelt AS ({" UNION ALL ".join(f"SELECT t, {n} AS n, spot, concat_ws(' ', word, {', '.join(f'w{k}' for k in range(1, n))}) AS gram FROM ahead WHERE w{n - 1} IS NOT NULL" for n in range(5, 11))}),
    repeated AS (SELECT t, n, gram FROM spelt GROUP BY t, n, gram HAVING count(*) > 1),
    inside AS (SELECT DISTINCT t, n, unnest(range(spot, spot + n)) AS spot FROM spelt JOIN repeated USING (t, n, gram)),
    covered AS (SELECT t, n, count(*) AS words, sum(length(word)) AS chars FROM inside JOIN words USING (t, spot) GROUP BY t, n),
    lines AS (SELECT t, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM texts),
    again AS (SELECT t, line, row_number() OVER (PARTITION BY t, line ORDER BY nth) AS copy FROM lines WHERE regexp_matches(line, '{_WORDS}')),
    dup AS (SELECT t, count(*) AS n, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g'))) AS chars FROM again WHERE copy > 1 GROUP BY t),
    counted AS (
        SELECT t, doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
               coalesce(dup.n, 0) AS n_dup_lines, CAST(coalesce(dup.chars, 0) AS BIGINT) AS dup_line_chars,
               coalesce((SELECT c.words FROM covered c WHERE c.t = texts.t AND c.n = 8), 0) AS n_repeat_words,
               coalesce((SELECT max(c.chars) FROM covered c WHERE c.t = texts.t), 0) AS most_chars
        FROM texts LEFT JOIN per_text USING (t) LEFT JOIN dup USING (t)
    ),
    judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, dup_line_chars,
           NOT base_failed AND dup_line_chars <= 0.30 * word_chars AND most_chars <= 0.30 * word_chars AS kept
    FROM judged
"""

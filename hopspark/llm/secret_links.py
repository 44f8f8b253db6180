"""Secret scans: parts of a credential that stand close together are linked.

A key, token or password that matches one of the three base patterns is reported by
itself.  Beyond those there are weak candidates: account names, e-mail addresses and key
identifiers (``identifier``), random-looking strings (``secret``) and hosts
(``endpoint``).  None of them means much alone, so each opens an interval of ``reach``
characters on both sides, cut to its scope (the paragraph it stands in), and the
intervals are joined: a weak secret is reported when it meets an identifier or endpoint,
a weak identifier or endpoint when it meets a secret of either kind.

The interval join sweeps the sorted parts of a scope once, keeping the nearest part of
each role on either side; the number of pairs never matters.  Scopes lie within a text,
so there is no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hopspark.llm.common import slices

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
REACH = 160

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_weak long, n_links long"

# The base patterns.
_ASSIGN = re.compile(
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of [0-9a-f]+ that have 24 characters or more.
_HEX = re.compile(r"[0-9a-f]{24,}")

_IDENTIFIER = re.compile(
    r"\b(?:user(?:_?name|_?id)?|login|account(?:_?id)?|client_?id|access_?(?:key_?)?id|key_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@+-]{3,}"
    r"|(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+",
    re.I | re.A,
)
_ENDPOINT = re.compile(
    r"\b[a-z][a-z0-9+.-]{0,20}://[^\s\"'<>]+|\b(?:host|hostname|server|endpoint)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.:-]{3,}|\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b",
    re.I | re.A,
)
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping for each kind."""
    out = [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if ":" in text or "=" in text else []
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return out


def _random_looking(token: str) -> bool:
    """Letters of both cases and digits, and no character much more frequent than in random text."""
    if not (re.search("[a-z]", token) and re.search("[A-Z]", token) and re.search("[0-9]", token)):
        return False
    _, counts = np.unique(list(token), return_counts=True)
    share = counts / counts.sum()
    return float(-(share * np.log2(share)).sum()) >= 3.5


def _scopes(text: str) -> list[int]:
    """Where paragraphs begin."""
    return [0, *(m.end() for m in re.finditer(r"\n[ \t\r]*\n", text))]


def linked(text: str, base: list[tuple[int, str, int]], reach: int = REACH) -> tuple[list[tuple[int, str, int]], int]:
    """The weak spans that meet a complementary part, and the number of parts that did."""
    starts, ends = [], []
    for a, _, b in sorted(base):  # disjoint intervals that base spans take up
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def free(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return k == 0 or ends[k - 1] <= a

    # Each part: start, end, role, kind; roles: 0 identifier, 1 secret, 2 endpoint.
    parts = [(a, b, 0 if kind == "access" else 1, kind) for a, kind, b in base]
    if "@" in text or "=" in text or ":" in text:
        parts += [(m.start(), m.end(), 0, "identifier") for m in _IDENTIFIER.finditer(text) if free(*m.span())]
    parts += [(m.start(), m.end(), 1, "secret") for m in _TOKEN.finditer(text) if free(*m.span()) and _random_looking(m[0])]
    if not any(x[2] == 1 for x in parts):
        return [], 0
    parts += [(m.start(), m.end(), 2, "endpoint") for m in _ENDPOINT.finditer(text) if free(*m.span())]
    if len({x[2] for x in parts}) < 2:
        return [], 0
    scopes = _scopes(text)
    parts.sort()
    meets = [[False] * 3 for _ in parts]
    # One sweep in each direction: the furthest end (nearest start) so far of each role, in this scope.
    for order, back in ((range(len(parts)), False), (range(len(parts) - 1, -1, -1), True)):
        scope, near = -1, [None] * 3
        for i in order:
            a, b, role, _ = parts[i]
            here = bisect_left(scopes, a + 1) - 1
            if here != scope:
                scope, near = here, [None] * 3
            for other in range(3):
                if near[other] is not None and (near[other] - b if back else a - near[other]) <= reach:
                    meets[i][other] = True
            if back:
                near[role] = a if near[role] is None else min(a, near[role])
            else:
                near[role] = b if near[role] is None else max(b, near[role])
    whole = lambda i: parts[i][2] != 1 and meets[i][1] or parts[i][2] == 1 and (meets[i][0] or meets[i][2])
    found = [(parts[i][0], parts[i][3], parts[i][1]) for i in range(len(parts)) if parts[i][3] in KINDS[3:] and whole(i)]
    return found, sum(map(whole, range(len(parts))))


def listed(spans: list[tuple[int, str, int]]) -> str:
    """Spans as text, by start and then kind."""
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2])))


def scan(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]], int]:
    """(base spans, weak spans, linked parts) of one text."""
    base = base_spans(text)
    return base, *linked(text, base)


def _scan_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        for data in batch.column(1):
            base, weak, links = scan(data.as_py() or "")
            count = lambda k: sum(kind == k for _, kind, _ in base)  # noqa: B023, E731
            digest = hashlib.sha256(listed(base).encode()).hexdigest()
            rows.append((count("assign"), count("access"), count("hex"), digest, listed(base + weak), len(weak), links))
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
        cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], [x.split()[0] for x in SCHEMA.split(", ")])


def secret_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts of base spans, their digest, and all spans as text.

    Spans are ``kind:start:end`` in code points, end exclusive, comma-joined by start and
    then kind.  Null and empty texts have none (the digest is that of the empty string).
    Repeated rows and null ids are scanned like any other; other columns are ignored.
    """
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(_scan_rows, SCHEMA)


def redact(docs: DataFrame, text: str = "text", mark: str = "[REDACTED]", count: str | None = None) -> DataFrame:
    """``docs`` with every span of :func:`secret_scan` in ``text`` replaced by ``mark``.

    All columns and rows are kept; texts without spans, null ones among them, stay as
    they are.  Overlapping spans become one mark.  With ``count``, that column gets the
    length in code points of each text that changed.
    """
    schema = docs.schema
    at = schema.fieldNames().index(text)
    counted = schema.fieldNames().index(count) if count else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            old = batch.column(at).to_pylist()
            new = [x if x is None else cover(x, mark) for x in old]
            cols = list(batch.columns)
            cols[at] = pa.array(new, batch.schema.field(at).type)
            if counted is not None:
                sizes = [c if a is b or a == b else len(b) for a, b, c in zip(old, new, batch.column(counted).to_pylist(), strict=True)]
                cols[counted] = pa.array(sizes, batch.schema.field(counted).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, schema)


def cover(text: str, mark: str) -> str:
    base, weak, _ = scan(text)
    if not base and not weak:
        return text
    out, last = [], 0
    for a, _, b in sorted(base + weak, key=lambda s: (s[0], s[2])):
        if a >= last:
            out += [text[last:a], mark]
        last = max(last, b)
    return "".join([*out, text[last:]])

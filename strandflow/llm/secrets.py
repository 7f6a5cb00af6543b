"""Secret scans with multipart credential linking.

Strong spans stand alone: an assignment to a secret's name (assign), an access key id (access), a long
hexadecimal string (hex). Weak parts are an identifier (user or client name), a value (a long token of mixed
characters) and an endpoint (a URL, host or connection string). Alone they are ordinary text. An interval join
within scopes (paragraphs: text between blank lines) looks, for every weak part, for the complementary parts that
lie within GAP characters:

* a value counts with an identifier, an access key or an endpoint;
* an identifier counts with a value, an assignment or a hexadecimal string;
* an endpoint counts only with both kinds.

Parts are sorted by position, and each weak part looks only at the nearest part of each kind to its left and right: the work is in
proportion to the spans, however many one scope holds. Weak parts that overlap a strong span are left out. GAP is the width of the interval join, not a
bound on work: parts further apart are taken for unrelated. Offsets are code points, the end exclusive.

Null text is empty and has no spans; texts of any length are scanned whole. Rows are judged one by one, so repeated rows and ids don't matter. Spans that
start together come in the order of KINDS. The whole row travels as _row, so its columns may have any names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

KINDS = ("assign", "access", "hex", "identifier", "value", "endpoint")
GAP = 300
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
IDENTIFIER = r"""(?:user(?:name)?|login|client_?id|account|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]{3,})"""
VALUE = r"[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"""(?:[a-z][a-z0-9+]{1,9}://[^\s"'<>]+|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+)"""
SPANS = "array<struct<kind:string,start:int,end:int>>"


def _compiled() -> dict:
    flags = re.ASCII | re.IGNORECASE
    return {
        "assign": re.compile(ASSIGN, flags), "access": re.compile(ACCESS), "hex": re.compile(r"[0-9a-f]{24,}"), "identifier": re.compile(IDENTIFIER, flags),
        "value": re.compile(VALUE), "endpoint": re.compile(ENDPOINT, flags),
    }


def _strong(patterns: dict, text: str) -> list[tuple[int, str, int]]:
    found = [(m.start(), "assign", m.end()) for m in patterns["assign"].finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), "access", m.end()) for m in patterns["access"].finditer(text) if m.end() - m.start() >= 20]
    # A run of 24 or more is a maximal run: shorter runs fail whole, without retries inside.
    return found + [(m.start(), "hex", m.end()) for m in patterns["hex"].finditer(text)]


def _looks_random(value: str) -> bool:
    return bool(re.search("[0-9]", value)) and bool(re.search("[a-z]", value)) and bool(re.search("[A-Z]", value)) and len(set(value)) >= 12


def _weak(patterns: dict, text: str, strong: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    taken = sorted((s, e) for s, _, e in strong)
    starts = [s for s, _ in taken]
    reach = list(accumulate((e for _, e in taken), max))  # how far the strong spans up to each one go

    def free(a: int, b: int) -> bool:
        i = bisect_left(starts, b)
        return i == 0 or reach[i - 1] <= a

    found = [(m.start(), "identifier", m.end()) for m in patterns["identifier"].finditer(text)]
    found += [(m.start(), "endpoint", m.end()) for m in patterns["endpoint"].finditer(text)]
    found += [(m.start(), "value", m.end()) for m in patterns["value"].finditer(text) if _looks_random(m[0])]
    return [(s, k, e) for s, k, e in found if free(s, e)]


def _linked(text: str, strong: list, weak: list) -> list:
    """The weak parts whose complementary parts co-occur within one scope, at most GAP characters away."""
    if not weak:
        return []
    breaks = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text)]
    by_kind: dict[str, list[tuple[int, int, int]]] = {}
    for s, kind, e in sorted(strong + weak):
        by_kind.setdefault(kind, []).append((bisect_left(breaks, s), s, e))

    def near(kind: str, start: int, end: int) -> bool:
        own = by_kind.get(kind, ())
        scope = bisect_left(breaks, start)
        i = bisect_left(own, (scope, start, end))
        for other in own[max(0, i - 1) : i + 2]:
            if other[0] == scope and (other[1], other[2]) != (start, end) and other[1] - end <= GAP and start - other[2] <= GAP:
                return True
        return False

    def counts(kind: str, s: int, e: int) -> bool:
        who = near("access", s, e) or near("identifier", s, e)
        what = near("assign", s, e) or near("hex", s, e) or near("value", s, e)
        where = near("endpoint", s, e)
        return {"value": who or where, "identifier": what, "endpoint": who and what}[kind]

    return [(s, kind, e) for s, kind, e in weak if counts(kind, s, e)]


def scan_text(patterns: dict, text: str | None) -> list[tuple[int, str, int]]:
    """All spans (start, kind, end) by start, then kind."""
    if not text:
        return []
    strong = _strong(patterns, text)
    spans = strong + _linked(text, strong, _weak(patterns, text, strong))
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


def redacted(text: str | None, spans: list[tuple[int, str, int]], mark: str = "[REDACTED]") -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _scan(redact: bool):
    def run(batches):
        patterns = _compiled()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            spans = [scan_text(patterns, t) for t in texts]
            out = pa.array([[{"kind": k, "start": s, "end": e} for s, k, e in own] for own in spans], kind)
            clean = pa.array([redacted(t, own) if redact else None for t, own in zip(texts, spans)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("_row"), out, clean], names=["_row", "spans", "redacted"])

    return run


def find_secrets(docs: DataFrame, text_col: str = "text", redact: bool = False) -> DataFrame:
    """_row (the whole row), spans (kind, start, end; by start, then kind), and redacted: the text without them, if asked for."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return docs.select(row, F.col(text_col).cast("string").alias("_text")).mapInArrow(_scan(redact), f"_row {docs.schema.simpleString()}, spans {SPANS}, redacted string")


ship(__name__)

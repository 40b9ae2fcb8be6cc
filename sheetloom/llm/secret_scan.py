"""Secret spans: fixed patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

import re
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl_type, map_rows

#: Kinds of span in their order, and the base patterns with the least length each must reach.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
_HINT = re.compile(r"[:=]")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Candidates: runs of the union of all classes, this long at least.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Character classes and the bits per character that a window of that class must reach.
CLASSES = (("digit", frozenset("0123456789"), 3.0), ("hex", frozenset("0123456789abcdefABCDEF"), 3.0), ("base64", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 3.7))
#: Runs that are no secrets: letters of one case only, paths and slugs of plain words, uuids, digits between separators.
ALLOWED = re.compile(r"[a-z]+|[A-Z]+|[A-Z]?[a-z]+(?:[-_/][A-Za-z]?[a-z]+)+|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9]*(?:[-_=+/]+[0-9]*)+")
#: Samples: a window that holds one is no secret; other windows of its run may be.
SAMPLE = re.compile(r"(?=(EXAMPLE|example|xxxx|XXXX|1234567890|abcdefghij))")
_PLOGP = [0.0, *(n * log2(n) for n in range(1, WINDOW + 1))]


def entropy_spans(run: str) -> list[tuple[int, int]]:
    """Merged windows of run whose characters belong to one class and whose entropy reaches the class's limit.

    Counts and the sum of n log n are updated by one character in and one out at each step."""
    found: list[tuple[int, int]] = []
    samples = [m.span(1) for m in SAMPLE.finditer(run)]
    for _, members, limit in CLASSES:
        counts, total, start = {}, 0.0, 0
        for i, c in enumerate(run):
            if c not in members:
                counts, total, start = {}, 0.0, i + 1
                continue
            n = counts.get(c, 0)
            total += _PLOGP[n + 1] - _PLOGP[n]
            counts[c] = n + 1
            if i - start >= WINDOW:
                out = run[start]
                n = counts[out]
                total += _PLOGP[n - 1] - _PLOGP[n]
                counts[out] = n - 1
                start += 1
            if i - start == WINDOW - 1 and log2(WINDOW) - total / WINDOW >= limit and not any(start <= s and e <= i + 1 for s, e in samples):
                found.append((start, i + 1))
    merged: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if merged and s <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    return merged


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the fixed patterns, leftmost and without overlap within a kind."""
    found = []
    if _HINT.search(text):
        low = text.lower()
        if any(w in low for w in _WORDS):
            found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def find_spans(text: str | None) -> list[tuple[int, int, str]]:
    """All spans of a text by start, then kind. Entropy spans keep what base spans do not cover."""
    if not text:
        return []
    spans = base_spans(text)
    base = sorted(spans)
    for m in CANDIDATE.finditer(text):
        if ALLOWED.fullmatch(m[0]):
            continue
        for s, e in entropy_spans(m[0]):
            s, e = s + m.start(), e + m.start()
            for a, b, _ in base:
                if s < b and a < e:
                    if s < a:
                        spans.append((s, a, "entropy"))
                    s = b
            if s < e:
                spans.append((s, e, "entropy"))
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2])))


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _span_column(texts: pa.Array) -> pa.Array:
    return pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in find_spans(x)] for x in texts.to_pylist()], _ARROW_SPANS)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans) for each row: code-point spans of every secret in the whole text, end exclusive.

    A null or empty text has no spans; very long texts are read whole. Spans that begin together come in the
    order of their kinds. Null ids and repeated rows come back as they are; other columns are not read; an
    empty table gives an empty result. Nothing is shuffled."""

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _span_column(b.column(1))], names=[id_col, "spans"])

    picked = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    return map_rows(picked, work, f"`{id_col}` {ddl_type(docs, id_col)}, spans {SPANS}")


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """text with each maximal stretch of overlapping spans replaced by mark."""
    if not text:
        return text
    out, at = [], 0
    for s, e, _ in find_spans(text):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret span of text_col replaced by mark; all rows and columns stay, whatever their names; null and
    empty texts stay as they are, and an empty table stays empty."""
    names = docs.columns
    at = names.index(text_col)

    def work(batches):
        for b in batches:
            new = pa.array([redact(x, mark) for x in b.column(at).to_pylist()], b.column(at).type)
            yield pa.RecordBatch.from_arrays([new if i == at else b.column(i) for i in range(b.num_columns)], names=b.schema.names)

    from .common import slices

    return docs.mapInArrow(lambda batches: work(slices(batches, at)), docs.schema)

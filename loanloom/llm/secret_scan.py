"""Secrets in texts: known forms, and strings of high entropy.

Known forms are assignments to telling names, access keys and long hexadecimal strings. Beyond those, every run of at least
``WINDOW`` characters that could belong to an encoded secret is a candidate: a window slides over it, and the Shannon entropy of
the characters in the window is kept up to date from the counts of the one character that enters and the one that leaves. The
character class (digits, hexadecimal, letters and digits, all) sets the entropy from which a string counts as random. What
placeholder words and UUIDs leave of a candidate is scored as a whole and, by their own classes, in its parts between ``=``,
``/`` and ``_``; one random string makes the whole candidate a span. Strings on the allow-list, and candidates inside a span
already found, are suppressed.

Spans are (kind, start, end) in code points, the end exclusive.

Defined results: null text is empty and has no spans; matches of one kind are leftmost and do not overlap; a match that is
too short is dropped, what it covered is not searched again; repeated rows give repeated results; further columns are
ignored; an empty table gives an empty result. A text of any length is searched as one string, never cut.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

ASSIGN, ACCESS, HEX, ENTROPY = KINDS = ("assign", "access", "hex", "entropy")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.ASCII | re.IGNORECASE)
# Without a telling name in a text the pattern above need not be tried.
_TELLING = ("passw", "secret", "token", "api")
# Greedy runs, so asking for the least length at once gives the same matches.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")

WINDOW = 24
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
_BETWEEN = re.compile(r"[=/_]+")
# Character classes, from narrow to wide, and the entropy in bits from which a window counts as random: the 1 % quantile of
# uniformly random strings of WINDOW characters (10, 16, 62 and 64 different ones).
CLASSES = (("digits", re.compile(r"[0-9]+"), 2.62), ("hex", re.compile(r"[0-9A-Fa-f]+"), 3.04),
           ("word", re.compile(r"[A-Za-z0-9]+"), 3.85), ("all", re.compile(r"[A-Za-z0-9+/_=-]+"), 3.88))
_UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
# A part of a path or a name: letters of one case (perhaps a capital first) and up to four digits.
_WORD = r"(?:(?:[A-Z]?[a-z]{1,20}|[A-Z]{1,20})[0-9]{0,4}|[0-9]{1,4})"
# Harmless although they may look random.
ALLOWED = (re.compile(r"[A-Za-z]+"), re.compile(r"(.{1,12}?)\1+.{0,12}"),
           re.compile(r"[A-Za-z]{1,20}([-_/=+]+[A-Za-z]{1,20})*[-_/=+]*[0-9]{0,4}"), re.compile(_UUID),
           re.compile(rf"[-_/=+]*{_WORD}(?:[-_/=+]+{_WORD})*[-_/=+]*"))
# Harmless by themselves; what stands before and after them is not.
_HARMLESS = re.compile(r"(?<![A-Za-z0-9])(?:(?i:example|sample|dummy|test|placeholder|x{4,})|" + _UUID + r"(?![A-Za-z0-9]))")

Span = tuple[str, int, int]


def largest_entropy(text: str, window: int = WINDOW) -> float:
    """The largest Shannon entropy, in bits, of the characters in any window of the text (or in all of a shorter text).

    With counts c the entropy is log2(n) - sum(c * log2(c)) / n, so a step changes two terms of the sum.
    """
    width = min(window, len(text))
    if not width:
        return 0.0
    terms = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    counts: dict[str, int] = {}
    total = least = 0.0
    for i, entering in enumerate(text):
        if i >= width:
            leaving = text[i - width]
            c = counts[leaving]
            total += terms[c - 1] - terms[c]
            counts[leaving] = c - 1
        c = counts.get(entering, 0)
        total += terms[c + 1] - terms[c]
        counts[entering] = c + 1
        if i == width - 1:
            least = total
        elif i >= width and total < least:
            least = total
    return math.log2(width) - least / width


def is_random(text: str, window: int = WINDOW) -> bool:
    if len(text) < window or any(pattern.fullmatch(text) for pattern in ALLOWED):
        return False
    limit = next(limit for _, pattern, limit in CLASSES if pattern.fullmatch(text))
    return largest_entropy(text, window) >= limit


def looks_random(candidate: str, window: int = WINDOW) -> bool:
    if any(pattern.fullmatch(candidate) for pattern in ALLOWED):
        return False
    return any(is_random(text, window) for rest in _HARMLESS.split(candidate) for text in (rest, *_BETWEEN.split(rest)))


def base_spans(text: str) -> list[Span]:
    """Spans of the known forms, by start, then kind."""
    spans = []
    lower = text.lower()
    if any(name in lower for name in _TELLING):
        spans += [(ASSIGN, *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        spans += [(ACCESS, *m.span()) for m in _ACCESS.finditer(text)]
    spans += [(HEX, *m.span()) for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def entropy_spans(text: str, known: list[Span]) -> list[Span]:
    """Random-looking candidates that no known span covers."""
    return [(ENTROPY, *m.span()) for m in _CANDIDATE.finditer(text)
            if not any(a <= m.start() and m.end() <= b for _, a, b in known) and looks_random(m.group())]


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans by start, then kind."""
    base = base_spans(text)
    return base, sorted(base + entropy_spans(text, base), key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [find_spans(text or "") for text in batch.column("text").to_pylist()]
        count = lambda kind: pa.array([sum(s[0] == kind for s in every) for _, every in found], pa.int64())
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), **{f"n_{kind}": count(kind) for kind in KINDS},
            "base_sha256": pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()),
            "spans": pa.array([joined(every) for _, every in found], pa.string())})


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, number of spans by kind, base_sha256 (digest of the known forms' spans) and spans of every row."""
    docs = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    return docs.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, "
                                  "base_sha256 string, spans string")


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones together, replaced by the mark."""
    out, at = [], 0
    for _, start, end in find_spans(text)[1]:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced and, if there is such a column, ``n_chars`` of changed texts renewed.

    Null texts stay null; all columns and their order stay.
    """
    schema = docs.schema
    at = schema.names.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            changed = [text if text is None else redacted(text) for text in texts]
            columns = list(batch.columns)
            columns[at] = pa.array(changed, columns[at].type)
            if "n_chars" in schema.names:
                k = schema.names.index("n_chars")
                columns[k] = pa.array([n if new == old else len(new) for n, new, old in
                                       zip(columns[k].to_pylist(), changed, texts)], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(rows, schema)

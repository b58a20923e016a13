"""Secrets in texts: fixed patterns, and windows of high entropy.

Method: every candidate string (a long run of token characters) is read with a
sliding window.  The window's character counts are kept up to date by one
character in and one out, and with them its Shannon entropy; each character
class has its own threshold.  Runs of hex digits inside a longer candidate are
held to their own class's threshold, whatever they are glued to, and a hit takes
the whole run it is in.  Candidates and runs on the allow-list are not reported.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridtide.llm.words import forget_others, text_chunks

#: The patterns of the three base kinds, in the order of listing.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")

#: Characters of a window, and of the shortest candidate.
WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Bits of entropy a window needs, by the class of its candidate.
THRESHOLDS = {"hex": 3.0, "base64": 3.75}
HEX_ONLY = re.compile(r"[0-9a-fA-F]+")
HEX_RUN = re.compile(r"[0-9a-fA-F]{20,}")
#: Runs that a hit is extended to; other characters of candidates may stand between a name and its value.
RUN = re.compile(r"[A-Za-z0-9+]+")
#: Allow-list: candidates of these forms are no secrets.
ALLOWED = (
    re.compile(r"[A-Za-z_=/+-]+"),  # words and rulers: no digit
    re.compile(r"[0-9_=/+-]+"),  # numbers, dates, rulers: no letter
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),  # UUIDs
    # A name with a number; its parts end in a small letter.  Each part is taken whole, never given back.
    re.compile(r"[A-Z]?[a-z]+(?:[_/-](?>[A-Za-z]+)(?<=[a-z]))*[0-9]{1,4}"),
)
_XLOGX = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]

SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)]),
    False,
)


def allowed(candidate: str) -> bool:
    return any(form.fullmatch(candidate) for form in ALLOWED)


def entropy_spans(candidate: str) -> list[tuple[int, int]]:
    """Unions of the windows of ``candidate`` whose entropy reaches the threshold."""
    need = THRESHOLDS["hex" if HEX_ONLY.fullmatch(candidate) else "base64"]
    most = WINDOW * (math.log2(WINDOW) - need)  # entropy = log2(n) - sum(c log2 c) / n
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    for i, c in enumerate(candidate):
        old = counts.get(c, 0)
        counts[c] = old + 1
        total += _XLOGX[old + 1] - _XLOGX[old] if old < WINDOW else 0.0
        if i >= WINDOW:
            gone = candidate[i - WINDOW]
            old = counts[gone]
            counts[gone] = old - 1
            total -= _XLOGX[min(old, WINDOW)] - _XLOGX[old - 1]
        if i >= WINDOW - 1 and total <= most + 1e-9:
            begin = i - WINDOW + 1
            if spans and begin <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((begin, i + 1))
    return spans


def candidate_spans(candidate: str) -> list[tuple[int, int]]:
    """What of ``candidate`` is reported: its windows and those of its hex runs, each out to the ends of the runs it is in."""
    found = entropy_spans(candidate)
    for m in HEX_RUN.finditer(candidate):
        if not allowed(m[0]) and entropy_spans(m[0]):
            found.append(m.span())
    if not found:
        return found
    runs = [m.span() for m in RUN.finditer(candidate)]
    if found != [(0, len(candidate))]:
        # Hex runs are found whole; beyond them a hit goes on to the end of the letters and digits it lies in.
        hexes = {m.span() for m in HEX_RUN.finditer(candidate)}
        found = [s if s in hexes else (min([s[0], *(a for a, b in runs if a < s[0] < b)]), max([s[1], *(b for a, b in runs if a < s[1] < b)])) for s in found]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of every find, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for m in CANDIDATE.finditer(text):
        if not allowed(m[0]):
            found += [(m.start() + a, 3, m.start() + b) for a, b in candidate_spans(m[0])]
    return sorted(found)


def find_secrets(df: DataFrame, column: str = "text", spans: str = "spans") -> DataFrame:
    """``df`` with ``spans``: the finds of each whole text as (kind, start, end).

    Positions are code points, the end is exclusive; finds are sorted by start,
    then by kind in the order of ``KINDS``.  A find of one kind may lie inside a
    find of another.  Null and empty texts have no finds (an empty array).  A
    column already called like ``spans`` is replaced, all others and repeated
    rows stay.  Nothing is shuffled.
    """
    kept = [f for f in df.schema.fields if f.name != spans]
    place = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        kind = pa.list_(pa.struct([pa.field("kind", pa.string(), False), pa.field("start", pa.int32(), False), pa.field("end", pa.int32(), False)]))
        for batch in batches:
            for a, b in text_chunks(batch[column]):
                part = batch.slice(a, b - a)
                found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans_of(t)] if t else [] for t in part[column].to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part[n] for n in place), pa.array(found, kind)], names=[*place, spans])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField(spans, SPANS)]))


def redact_secrets(df: DataFrame, column: str = "text", mark: str = "[secret]") -> DataFrame:
    """``df`` with every find in ``column`` replaced by ``mark``; overlapping finds become one mark.

    Texts without finds, null texts among them, stay as they are.
    """
    place = [f.name for f in df.schema.fields]

    def clean(text: str | None) -> str | None:
        if not text or not (found := spans_of(text)):
            return text
        out, at = [], 0
        for start, _, end in found:
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in batches:
            for a, b in text_chunks(batch[column]):
                part = batch.slice(a, b - a)
                texts = pa.array([clean(t) for t in part[column].to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([texts if n == column else part[n] for n in place], names=place)

    return df.mapInArrow(run, df.schema)

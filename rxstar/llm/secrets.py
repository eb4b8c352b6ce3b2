"""Secret scans: fixed formats, and sliding-window Shannon entropy.

Formats (assign, access, hex) are leftmost non-overlapping matches; those that fail their check
are dropped.  Besides them, candidate strings are runs of token characters.  A window slides
over each one, and its entropy is kept up to date from counts, one character in and one out.
Windows over the threshold of their own (narrowest) character class merge into a span.  An
allow-list cuts out of a candidate what is known to be harmless (words of placeholders up to the
next separator, counting runs, identifiers in a standard layout) and never more; windows of
numbers are left out, windows without a digit have a higher threshold.  The formats' own spans are never suppressed, and an
entropy span that lies within one of them adds nothing and is left out.

Offsets are code points, ends exclusive.  Null text counts as empty: no spans.  Repeated rows are
scanned alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import fixed_rows, read, ship, texts

KINDS = ("assign", "access", "hex", "entropy")
BASE = KINDS[:3]
# fixed values: the formats
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs: a shorter one fails and hides no other
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
LEAST_VALUE, LEAST_ACCESS = 6, 20

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % WINDOW)
#: Character classes from narrow to wide, with the bits a character that a window of theirs must exceed.
CLASSES = (
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), 3.0),
    ("lower or upper", re.compile(r"[a-z0-9]+|[A-Z0-9]+"), 3.7),
    ("base64", re.compile(r"[A-Za-z0-9+/_-]+"), 3.9),
)
#: The allow-list: windows that are never judged, windows without a digit (prose, paths and names;
#: judged by a higher threshold), and parts that are cut out of a candidate.
NUMBER = re.compile(r"[0-9_/+-]+")
DIGITLESS, DIGITLESS_BITS = re.compile(r"[^0-9]+"), 4.0
#: Letters of both cases, so many of each in a window: names in words have few capitals, keys about half.
MIXED, MIXED_BITS = 7, 3.7
HARMLESS = re.compile(
    r"(?<![A-Za-z0-9])[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![A-Za-z0-9])"  # UUIDs
    r"|(?<![A-Za-z0-9])your[_-]"
    r"|(?<![A-Za-z0-9])(?=[A-Za-z0-9]*?(?:example|placeholder|changeme|dummy|sample|redacted))[A-Za-z0-9]+"  # up to the next separator
    r"|0123456789|abcdefghij|qwertyuiop",  # counting runs
    re.I,
)


def window_entropies(text: str, width: int = WINDOW) -> list[float]:
    """Bits a character of every window of ``width``, by incremental counts."""
    if len(text) < width:
        return []
    cost = [0.0] + [c * log2(c) for c in range(1, width + 1)]
    counts: dict[str, int] = {}
    total = 0.0  # the sum of c log c
    for ch in text[:width]:
        n = counts.get(ch, 0)
        total += cost[n + 1] - cost[n]
        counts[ch] = n + 1
    out = [log2(width) - total / width]
    for gone, come in zip(text, text[width:]):
        n = counts[gone]
        total += cost[n - 1] - cost[n]
        counts[gone] = n - 1
        n = counts.get(come, 0)
        total += cost[n + 1] - cost[n]
        counts[come] = n + 1
        out.append(log2(width) - total / width)
    return out


def least_bits(window: str) -> float:
    """The threshold of the narrowest class that holds all of a window."""
    if DIGITLESS.fullmatch(window):
        capitals, small = sum("A" <= c <= "Z" for c in window), sum("a" <= c <= "z" for c in window)
        return MIXED_BITS if min(capitals, small) >= MIXED else DIGITLESS_BITS
    return next(bits for _, chars, bits in CLASSES if chars.fullmatch(window))


def pieces(found: str) -> Iterator[tuple[int, str]]:
    """(offset, string): what the allow-list leaves of a candidate."""
    at = 0
    for m in HARMLESS.finditer(found):
        yield at, found[at : m.start()]
        at = m.end()
    yield at, found[at:]


def entropy_spans(text: str, width: int = WINDOW) -> list[tuple[int, int]]:
    """Merged windows over their own class's threshold, in what the allow-list leaves of the candidates."""
    spans: list[tuple[int, int]] = []
    for m in CANDIDATE.finditer(text):
        for offset, piece in pieces(m.group()):
            begin, open_at, end = m.start() + offset, -1, -1
            for i, bits in enumerate(window_entropies(piece, width)):
                if bits <= CLASSES[0][2] or NUMBER.fullmatch(piece, i, i + width) or bits <= least_bits(piece[i : i + width]):
                    continue
                if open_at >= 0 and i > end:
                    spans.append((begin + open_at, begin + end))
                    open_at = -1
                open_at, end = (i if open_at < 0 else open_at), i + width
            if open_at >= 0:
                spans.append((begin + open_at, begin + end))
    return spans


def secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    out = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    base = sorted((a, b) for _, a, b in out)
    for a, b in entropy_spans(text):
        if not any(x <= a and b <= y for x, y in base):
            out.append(("entropy", a, b))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _scan() -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in fixed_rows(batches, 1024):
            found = [
                [{"kind": k, "start": a, "end": b} for k, a, b in secrets(t.decode("utf-8", "replace"))]
                for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(_SPAN))], names=["doc_id", "found"])

    return run


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, found: array of kind, start, end) for every row of ``docs``."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), texts().alias("text"))
    return rows.mapInArrow(_scan(), "doc_id long, found array<struct<kind:string,start:int,end:int>>")


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    found = find_secrets(read(spark, sf_dir, "documents", "doc_id", "text"))

    def of(kind: str) -> Column:
        return F.filter("found", lambda s: s.kind == kind)

    base = F.filter("found", lambda s: s.kind != "entropy")
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )

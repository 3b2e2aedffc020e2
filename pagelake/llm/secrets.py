"""Secret scans: named patterns, and sliding-window Shannon entropy per character class.

A candidate string of one character class is slid over with a window whose symbol counts change by one in
and one out; the sum of c log2 c over counts c follows by two table look-ups, so entropy costs constant
time a step. Windows above the class's threshold join to spans; strings too short for the window get a
shorter one, and the same share of its greatest entropy. An allow list drops strings that are random-looking
but harmless.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import spread, text_batches

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "entropy")
WINDOW = 24
SHORT = 12
_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: class -> (candidate pattern, least entropy in bits of a window of WINDOW); an = before a candidate, or between it and more, assigns
CLASSES = {
    "hex": (re.compile(r"(?<![A-Za-z0-9])[0-9A-F]{12,}(?![A-Za-z0-9])"), 3.0),
    "base64": (re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}+(?:={1,2}(?![A-Za-z0-9+/=_-]))?"), 4.0),
}
ALLOW = (
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),  # UUID
    re.compile(r"(?:sha(?:1|256|384|512)|md5)-.*"),  # integrity digests
    re.compile(r"[A-Za-z/_-]+"),  # words and paths: no digit
    re.compile(r"[0-9/_+-]+"),  # numbers and dates: no letter
    re.compile(r".*(?:example|sample|placeholder|xxxx).*", re.IGNORECASE),
)
#: of candidates below WINDOW characters also names and dates: each part a word, a number, or both in one change
ALLOW_SHORT = (*ALLOW, re.compile(r"(?:(?:[A-Za-z]++[0-9]*+|[0-9]++[A-Za-z]*+)?[/_+-])*+(?:[A-Za-z]++[0-9]*+|[0-9]++[A-Za-z]*+)?"))
_CLOGC = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]
_SHARE = math.log2(SHORT) / math.log2(WINDOW)
_LONG = re.compile(r"[A-Za-z0-9+/_-]{12}")


def entropy_runs(text: str, least: float, window: int = WINDOW):
    """(start, end) of maximal joined windows whose entropy is at least ``least`` bits."""
    counts: dict[str, int] = {}
    total, run = 0.0, None
    top = math.log2(window)
    for k, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _CLOGC[n + 1] - _CLOGC[n] if n < window else 0.0
        if k >= window:
            old = text[k - window]
            n = counts[old]
            counts[old] = n - 1
            total += _CLOGC[n - 1] - _CLOGC[n] if n <= window else 0.0
        if k >= window - 1 and top - total / window >= least - 1e-9:
            a = k - window + 1
            if run and a <= run[1]:
                run = (run[0], k + 1)
            else:
                if run:
                    yield run
                run = (a, k + 1)
    if run:
        yield run


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three named patterns, by start, then kind as listed; ends are exclusive."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], BASE.index(s[0])))


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as disjoint ones in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _overlaps(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether a disjoint span in order overlaps [a, b)."""
    k = bisect.bisect_left(taken, (b,))
    return k > 0 and taken[k - 1][1] > a


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans, by start, then kind: base ones, and entropy ones that overlap none of them."""
    text = text or ""
    base = base_spans(text)
    if not _LONG.search(text):
        return base
    more, taken = [], _joined([(a, b) for _, a, b in base])
    for pattern, least in CLASSES.values():
        for m in pattern.finditer(text):
            bare = m[0].rstrip("=")
            short = len(bare) < WINDOW
            if any(a.fullmatch(bare) for a in ALLOW_SHORT) if short else any(a.fullmatch(m[0]) for a in ALLOW):
                continue
            runs = entropy_runs(bare, least * _SHARE, SHORT) if short else entropy_runs(m[0], least)
            for a, b in runs:
                a, b = a + m.start(), b + m.start()
                if not _overlaps(taken, a, b):
                    more.append(("entropy", a, b))
        taken = _joined([*taken, *((a, b) for _, a, b in more)])
    return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def _join(spans) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans`` (array of kind, start, end; code points, end exclusive). Map-only.

    Null and empty texts have no spans; null ids and repeated rows stay as they are; an empty table gives
    an empty result; columns other than doc_id and text are ignored.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    text_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = [[dict(zip(("kind", "start", "end"), s)) for s in find(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(kind))], ["doc_id", "spans"])

    schema = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
    return spread(docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"))).mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans; see :func:`secrets` for odd input."""
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]

    text_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(1):
                spans = find(t.as_py())
                base = [s for s in spans if s[0] in BASE]
                counts = [sum(s[0] == k for s in base) for k in BASE]
                rows.append((*counts, hashlib.sha256(_join(base).encode()).hexdigest(), _join(spans)))
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"
    return spread(docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"))).mapInArrow(run, schema)


def query(spark, sf_dir):
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

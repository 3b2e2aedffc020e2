"""Personal data: regular expressions propose spans, checksums confirm them, context words move the score.

Every pattern runs in time linear in the text: a run of digits is entered at its first digit only and never
backtracked into, and addresses are found from their @ sign.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import spread, text_batches

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
THRESHOLD = 0.5
NEAR = 40


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++")
_DIGIT = re.compile("[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: where an account number can start, and as far as it can go
_IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}))")
_TOKEN_END = re.compile(r"[A-Z0-9](?![A-Za-z0-9])")
#: length: countries whose account numbers have it
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN_LENGTH = {c: n for n, countries in _IBAN_LENGTHS.items() for c in countries.split()}
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile("[^0-9]+")
#: kind -> (score of a confirmed span, words nearby that raise it, words that lower it)
_CONTEXT = {
    "email": (0.9, "mail contact write", "example"),
    "ip": (0.7, "ip address host server", "version release section"),
    "card": (0.9, "card visa credit payment", "isbn order serial"),
    "phone": (0.7, "phone call tel fax mobile", "version"),
    "iban": (0.8, "iban bank account konto", ""),
    "ssn": (0.4, "ssn social security taxpayer", "part serial invoice"),
}
_WORDS = {k: (set(up.split()), set(down.split())) for k, (_, up, down) in _CONTEXT.items()}
_WORD = re.compile("[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k & 1:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def mod97(code: str) -> bool:
    rest = 0
    for c in code[4:] + code[:4]:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def _emails(text: str):
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ibans(text: str):
    """Account numbers that pass mod-97: of the country's length or the longest, elsewhere the longest that passes."""
    done = 0
    for m in _IBAN.finditer(text):
        if m.start() < done:
            continue
        ends = [e.end() for e in _TOKEN_END.finditer(text, m.start(), m.end(1) + 1) if e.end() <= m.end(1)]
        codes = {end: text[m.start() : end].replace(" ", "") for end in reversed(ends)}
        tried = [end for end, code in codes.items() if len(code) >= 15]
        if known := _IBAN_LENGTH.get(text[m.start() : m.start() + 2]):
            tried = [end for end in tried if len(codes[end]) == known] + tried[:1]
        if end := next((end for end in tried if mod97(codes[end])), None):
            yield m.start(), end
            done = end


def _octets(address: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in address.split("."))


def _score(text: str, kind: str, start: int, end: int) -> float:
    score, (up, down) = _CONTEXT[kind][0], _WORDS[kind]
    near = set(_WORD.findall((text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower()))
    return round(min(1.0, score + 0.3 * bool(near & up)) - 0.2 * bool(near & down), 2)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the four base kinds, by kind, then start; ends are exclusive."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if _octets(m[0])]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = _NOT_DIGIT.sub("", m[0])
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def more_spans(text: str) -> list[tuple[str, int, int]]:
    """Account numbers that pass mod-97 and social-security patterns; these need the score."""
    if not _DIGIT.search(text):
        return []
    out = [("iban", *s) for s in _ibans(text)]
    return out + [("ssn", *m.span()) for m in _SSN.finditer(text)]


def find(text: str | None) -> list[Span]:
    """All spans with scores: every base span, and further ones that score at least THRESHOLD."""
    text = text or ""
    out = [Span(*s, _score(text, *s)) for s in base_spans(text)]
    more = [Span(*s, _score(text, *s)) for s in more_spans(text)]
    return out + [s for s in more if s.score >= THRESHOLD]


def _join(spans) -> str:
    return ",".join([f"{s[0]}:{s[1]}:{s[2]}" for s in spans])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans`` (array of kind, start, end, score; code points, end exclusive). Map-only.

    Null and empty texts have no spans; null ids and repeated rows stay as they are; an empty table gives
    an empty result; columns other than doc_id and text are ignored.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    text_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = [[s._asdict() for s in find(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(kind))], ["doc_id", "spans"])

    schema = "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>"
    return spread(docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"))).mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans and scores (in the spans' order); see :func:`personal_data` for odd input."""
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "scores"]

    text_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(1):
                spans = find(t.as_py())
                base = [s for s in spans if s.kind in BASE]
                counts = [sum(s.kind == k for s in base) for k in BASE]
                scores = ",".join([f"{s.score:.2f}" for s in spans])
                rows.append((*counts, hashlib.sha256(_join(base).encode()).hexdigest(), _join(spans), scores))
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string, scores string"
    return spread(docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"))).mapInArrow(run, schema)


def query(spark, sf_dir):
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

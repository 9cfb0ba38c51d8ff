"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Base kinds (email, ip, card, phone) follow fixed patterns, leftmost and without
overlap within a kind; a match that fails its check is dropped and not tried
again. Base spans always stay. Further kinds (IBAN by mod 97, national phone
numbers and social security numbers by context) are added where their score
reaches ``ACCEPT`` and they touch no base span.

Offsets are code points, end exclusive. Null and empty texts have no spans.
Long runs of digits or address characters are read once: searches start only
where a match can.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The order of kinds that start at one place.
KINDS = ("email", "ip", "card", "phone", "iban", "national_phone", "ssn")
BASE = KINDS[:4]
ACCEPT, REACH = 0.6, 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits is taken whole or not at all, which gives the same leftmost matches.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_DIGITS = re.compile(r"[0-9]")

#: What a kind scores by its pattern and check alone, and the words nearby that raise it.
_PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "national_phone": 0.4, "ssn": 0.4}
_WORDS = {
    "email": r"e-?mail|contact|write",
    "ip": r"ip|address|host|server|login",
    "card": r"card|visa|credit|payment|mastercard",
    "phone": r"phone|tel|call|mobile|fax",
    "iban": r"iban|account|bank|transfer",
    "national_phone": r"phone|tel|call|mobile|fax",
    "ssn": r"ssn|social security|taxpayer",
}
_CONTEXT = {k: re.compile(rf"(?i)\b(?:{v})\b") for k, v in _WORDS.items()}
_AGAINST = re.compile(r"(?i)\b(?:version|example|isbn|build|release)\b")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    compact = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _emails(text: str):
    """Around each @: local characters back to the last match's end, then a domain."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        else:
            end = max(end, at)  # no match reaches over this @
        at = text.find("@", max(at + 1, end))


def _base(text: str):
    yield from (("email", *span) for span in _emails(text))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        digits = "".join(_DIGITS.findall(m[0]))
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span()
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGITS.findall(m[0])) <= 15:
            yield "phone", *m.span()


def _further(text: str):
    yield from (("iban", *m.span()) for m in _IBAN.finditer(text) if mod97(m[0]))
    yield from (("national_phone", *m.span()) for m in _NATIONAL.finditer(text))
    yield from (("ssn", *m.span()) for m in _SSN.finditer(text))


def score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - REACH) : start] + "\n" + text[end : end + REACH]
    change = 0.3 * bool(_CONTEXT[kind].search(near)) - 0.2 * bool(_AGAINST.search(near))
    return round(min(1.0, max(0.0, _PRIOR[kind] + change)), 2)


def find(text: str | None) -> list[dict]:
    """Spans by start, then kind as in ``KINDS``."""
    text = text or ""
    out = [{"kind": k, "start": a, "end": b, "score": score(text, k, a, b), "base": True} for k, a, b in _base(text)]
    taken = sorted((s["start"], s["end"]) for s in out)
    for k, a, b in _further(text):
        if (s := score(text, k, a, b)) >= ACCEPT and not any(x < b and a < y for x, y in taken):
            out.append({"kind": k, "start": a, "end": b, "score": s, "base": False})
    return sorted(out, key=lambda s: (s["start"], KINDS.index(s["kind"]), s["end"]))


_FIELDS = (("kind", T.StringType(), pa.string()), ("start", T.IntegerType(), pa.int32()), ("end", T.IntegerType(), pa.int32()), ("score", T.DoubleType(), pa.float64()), ("base", T.BooleanType(), pa.bool_()))
_SPANS = T.ArrayType(T.StructType([T.StructField(n, t) for n, t, _ in _FIELDS]))
_ARROW = pa.list_(pa.struct([(n, a) for n, _, a in _FIELDS]))


@F.arrow_udf(_SPANS)
def _find(texts: pa.Array) -> pa.Array:
    return pa.array((find(t.as_py()) for t in texts), _ARROW)


@F.arrow_udf(T.StringType())
def _redacted(texts: pa.Array) -> pa.Array:
    return pa.array((None if not t.is_valid else redact(t.as_py()) for t in texts), pa.string())


def redact(text: str) -> str:
    """``text`` with each stretch of spans replaced by its first kind's name in brackets."""
    out, last = [], 0
    for s in find(text):
        if s["start"] >= last:
            out += [text[last : s["start"]], f"[{s['kind'].upper()}]"]
        last = max(last, s["end"])
    return "".join([*out, text[last:]])


def with_spans(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """``df`` with array<struct<kind, start, end, score, base>>."""
    return df.withColumn(out, _find(F.col(text)))


def with_redacted(df: DataFrame, text: str = "text", out: str = "text") -> DataFrame:
    """``df`` with the redacted text as ``out``; null stays null."""
    return df.withColumn(out, _redacted(F.col(text)))


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

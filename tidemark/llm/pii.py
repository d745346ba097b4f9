"""Personal data: patterns propose spans, checksums confirm them, nearby words move their scores.

Defined cases: a null or empty text has no spans; spans are in code points, end exclusive; a text's length only costs
time in proportion (no pattern can backtrack over a long run); copies of a row give copies of its result; spans of one kind
never overlap, those of different kinds may, and of equal starts the longer is redacted; an empty table gives an empty result;
columns of other names are left alone, those named as a result are replaced, and the input needs no name but those passed in.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import extend

#: The kinds in the order of their listing. The first four are found in every text; the others need a checksum or context.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
#: Words that raise a kind's score when they stand nearby, and how far is near (code points).
CONTEXT = {
    "email": ("mail", "email", "contact", "write", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse", "login"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "telefon", "fax"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
#: The score of a confirmed span before context, and what context adds.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
BONUS, NEAR, SSN_LEAST = 0.35, 48, 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}|[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_DIGIT = re.compile("[0-9]")
_DOUBLED = str.maketrans("0123456789", "0246813579")


def luhn(digits: str) -> bool:
    """Whether the last digit is the Luhn check digit of those before it."""
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(map(int, even.translate(_DOUBLED)))) % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN without spaces leaves 1 modulo 97, its first four characters moved to the end, letters as 10 to 35."""
    moved = iban[4:] + iban[:4]
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from each @ outwards."""
    after, at = 0, text.find("@")
    while at >= 0:
        if at >= after and (m := _DOMAIN.match(text, at + 1)):
            start = at
            while start > after and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                after = m.end()
        at = text.find("@", at + 1)


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Confirmed IBANs: at each start the longest that mod97 confirms, trailing groups taken off one by one; where none is, the search goes on inside."""
    at = 0
    while m := _IBAN.search(text, at):
        at, end = m.start() + 4, m.end()
        while end > at:
            if mod97(text[m.start() : end].replace(" ", "")):
                yield m.start(), end
                at = end
                break
            end = text.rfind(" ", m.start(), end)


def spans_of(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as listed, then start. Base kinds are kept whatever their score."""
    if not text:
        return []
    found = [("email", *x) for x in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if "." in m[0] and all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    found.append(("phone", m.start(), m.end()))
        found += [("iban", *x) for x in ibans(text)]
        found += [("ssn", m.start(), m.end()) for m in _SSN.finditer(text)]
    out = []
    for kind, start, end in found:
        around = re.findall(r"[^\W\d_]+", (text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower())
        score = min(1.0, PRIOR[kind] + BONUS * any(w in CONTEXT[kind] for w in around))
        if kind != "ssn" or score >= SSN_LEAST:
            out.append((kind, start, end, round(score, 4)))
    return out


def redacted(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    parts, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def find_pii(docs: DataFrame, text: str = "text", keep: list[str] | None = None, spans_col: str = "spans", redacted_col: str = "redacted") -> DataFrame:
    """docs (or its columns in keep) with the spans of each text and the text with its spans replaced (null stays null)."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column(text).to_pylist()
        spans = [spans_of(t or "") for t in texts]
        fields = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in row] for row in spans]
        return [pa.array(fields, SPAN), pa.array([redacted(t, s) if s else t for t, s in zip(texts, spans, strict=True)], pa.string())]

    return extend(docs, text, f"`{spans_col}` array<struct<kind:string,start:bigint,end:bigint,score:double>>, `{redacted_col}` string", make, keep)


def digest(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) with counts and digests of the spans, the texts themselves left behind."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = []
        for value in batch.column(text).to_pylist():
            spans = spans_of(value or "")
            said = [f"{k}:{s}:{e}" for k, s, e, _ in spans]
            base = ",".join(x for x, s in zip(said, spans, strict=True) if s[0] in BASE)
            rows.append([*(sum(s[0] == k for s in spans) for k in BASE), hashlib.sha256(base.encode()).hexdigest(), ",".join(said), ",".join(f"{s[3]:g}" for s in spans)])
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        return [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()] * 3, strict=True)]

    return extend(docs, text, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string", make, keep)

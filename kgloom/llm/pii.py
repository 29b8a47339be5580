"""Operator 4: personal data by patterns, checksums and context.

Regular expressions propose spans: the four base kinds and some more.  Checksums
(Luhn for cards, mod-97 for international account numbers) and counts of digits
confirm them.  Words near a span then move its score up or down.  Base spans that
pass their check are always reported, with their score; the added kinds only
above ``MIN_SCORE``.

Patterns are anchored where a match can begin at all (a mark or the first digit
of a run), so time is linear in the text.  Positions count code points.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import table

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "national_id", "local_phone")
MIN_SCORE = 0.5
NEAR = 48                       # characters before and after a span that count as its context

# Scores without context, then the words that move them.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "national_id": 0.3, "local_phone": 0.3}
RAISE, LOWER = 0.25, 0.3
FOR = {
    "email": {"mail", "email", "contact", "write"}, "ip": {"ip", "address", "host", "server"},
    "card": {"card", "visa", "credit", "debit", "payment", "karte", "carte", "tarjeta"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "mobil"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta"},
    "national_id": {"ssn", "social", "security", "identity", "passport"},
    "local_phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "mobil"},
}
AGAINST = {"version", "order", "invoice", "isbn", "serial", "article", "page", "example", "section"}

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match inside a run of digits could only begin at its first digit.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_CALL = re.compile(r"(?<![0-9+])\(?0[0-9]{2,4}\)?[ /-][0-9]{3,4}[ -]?[0-9]{3,5}(?![0-9])")
_NOT_DIGIT = re.compile(r"[^0-9]")
_WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(text: str) -> bool:
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _emails(text: str):
    """Leftmost matches of local@domain: each begins at the earliest local character before its @."""
    at, free = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > free and (_LOCAL_CHARS[ord(text[lo - 1])] if text[lo - 1] < "\x80" else False):
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at + 1)):
            yield lo, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


_LOCAL_CHARS = [bool(_LOCAL.match(chr(c))) for c in range(128)]


def _digits(text: str) -> str:
    return _NOT_DIGIT.sub("", text)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Confirmed spans of each base kind, leftmost and non-overlapping within a kind."""
    out: dict[str, list[tuple[int, int]]] = {"email": list(_emails(text)) if "@" in text else []}
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
    out["card"] = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return out


def _scored(text: str, kind: str, lo: int, hi: int) -> float:
    near = set(_WORD.findall((text[max(0, lo - NEAR):lo] + " " + text[hi:hi + NEAR]).lower()))
    return round(SCORE[kind] + RAISE * bool(near & FOR[kind]) - LOWER * bool(near & AGAINST), 2)


def find(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of all spans: base kinds first, each by start."""
    spans = base_spans(text)
    out = [(k, lo, hi, _scored(text, k, lo, hi)) for k in BASE for lo, hi in spans[k]]
    more = {
        "iban": [m.span() for m in _IBAN.finditer(text) if mod97(m[0])],
        "national_id": [m.span() for m in _NATIONAL.finditer(text)],
        "local_phone": [m.span() for m in _CALL.finditer(text)],
    }
    for kind in ADDED:
        for lo, hi in more[kind]:
            if (score := _scored(text, kind, lo, hi)) >= MIN_SCORE:
                out.append((kind, lo, hi, score))
    return out


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
_SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>"


def _run(batches):
    for batch in batches:
        found = [[dict(zip(("kind", "start", "end", "score"), s)) for s in find(t.as_py() or "")] for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, _SPAN)], names=["doc_id", "spans"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for each input row; null text is empty, other columns are ignored."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_run, _SCHEMA)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind))

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *[count(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


QUERIES = {"op4_pii": op4_pii}
SQL: dict[str, str] = {}

"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freed

#: Kinds in the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone", "iban")

# Each run is entered at its first character only and taken whole, so no text is scanned twice;
# the matches are those of the plain patterns, leftmost and not overlapping.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")

#: Words within CONTEXT characters of a span that make its kind likelier.
CONTEXT_WORDS = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address", "addr"),
    "card": ("card", "visa", "credit", "payment", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
}
CONTEXT = 48
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9}

SPAN = "struct<kind:string,start:int,end:int,score:double,base:boolean>"


def luhn(digits: str) -> bool:
    """True if the digits pass the Luhn check."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """True if an account number (no blanks) leaves 1 by the mod-97 check."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        # The run of local characters before the sign, not before the end of the last match.
        start = at
        while start > done and (_LOCAL.match(text, start - 1, start)):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        if 15 <= len(plain := m[0].replace(" ", "")) <= 34 and mod97(plain):
            yield m.span()


_FIND = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans}


def find(text: str | None) -> list[tuple[str, int, int, float, bool]]:
    """Spans of a whole text by start, then kind: (kind, start, end, score, base).

    Offsets count code points, the end is exclusive. ``base`` marks the four plain kinds; account
    numbers confirmed by mod-97 are added to them. A context word nearby raises the score by 0.1.
    """
    if not text:
        return []
    found = []
    digits = any(d in text for d in "0123456789")
    for order, kind in enumerate(KINDS):
        if kind == "email" and "@" not in text or kind != "email" and not digits:
            continue
        for start, end in _FIND[kind](text):
            near = text[max(0, start - CONTEXT) : start].lower() + " " + text[end : end + CONTEXT].lower()
            score = BASE_SCORE[kind] + 0.1 * any(w in near for w in CONTEXT_WORDS[kind])
            found.append((start, order, end, kind, round(score, 2)))
    return [(kind, start, end, score, kind != "iban") for start, _, end, kind, score in sorted(found)]


def mask(text: str | None, least_score: float = 0.0) -> str | None:
    """The text with each span that scores enough replaced by its kind in brackets; of spans that overlap, the first."""
    if not text:
        return text
    out, done = [], 0
    for kind, start, end, score, _ in find(text):
        if score >= least_score and start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
            done = end
    return "".join([*out, text[done:]])


def spans(text: Column) -> Column:
    """Column of spans; null and empty texts have none, long texts are searched whole. No shuffle: each row stands alone."""

    @F.pandas_udf(f"array<{SPAN}>")
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from freed(lambda some: (pd.Series([find(x) for x in texts], dtype=object) for texts in some))(batches)

    return work(text)


def masked(text: Column) -> Column:
    """Column of masked texts; null stays null and an empty text empty. Each row stands alone."""

    @F.pandas_udf("string")
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from freed(lambda some: (pd.Series([mask(x) for x in texts], dtype=object) for texts in some))(batches)

    return work(text)


def joined(array: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, id_col: str = "doc_id", spans_col: str = "spans") -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and the list of all spans for each row."""
    s = F.col(spans_col)

    def count(kind: str) -> Column:
        return F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(count, KINDS[:4])
    base = F.filter(s, lambda x: x["base"])
    return found.select(id_col, *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(s).alias("spans"))

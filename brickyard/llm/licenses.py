"""Licence scans: ordered signature rules over plain words, gated by keywords, overlaps resolved by priority.

A text becomes lower-case words one space apart. The distinct words that are keywords of some rule pick
the rules worth trying; each of those is a regular expression over the words. Of the places found, one
that lies within the place of a stronger rule, or within a longer one of the same priority, is
suppressed; places of base rules always stay.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _PLAIN, as_bytes, freed, slices, small_batches
from .license_rules import Rule, rules

#: Bytes of a text whose words are looked up at once.
CHUNK = 1 << 20
FOUND = "array<struct<label:string,kind:string,start:int,end:int,weight:double,base:boolean>>"

_TYPE = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("weight", pa.float64()), ("base", pa.bool_())]))


class Signatures:
    """The compiled rules and the words that gate them."""

    def __init__(self, table: list[Rule]):
        self.rules = table
        self.patterns = [re.compile(b"(?<![^ ])(?:" + r.pattern.encode() + b")(?![^ ])") for r in table]
        self.keywords = frozenset(w.encode() for r in table for g in r.gates for w in g)
        self.gates = [[frozenset(w.encode() for w in g) for g in r.gates] for r in table]
        # A rule is looked at if the first word, by the alphabet, of one of its gates is there.
        self.by_word = defaultdict(list)
        self.always = [k for k, gates in enumerate(self.gates) if not all(gates)]
        for k, gates in enumerate(self.gates):
            for w in {min(g) for g in gates if g}:
                self.by_word[w].append(k)

    def worth_trying(self, words: set[bytes]) -> list[int]:
        """Numbers of the rules one of whose gates is within ``words``, in order."""
        near = {k for w in words for k in self.by_word.get(w, ())}
        return sorted({k for k in near if any(g <= words for g in self.gates[k])}.union(self.always))


@cache
def signatures() -> Signatures:
    return Signatures(rules())


def plain(text: bytes | None) -> bytes:
    """The words of a text (runs of letters, digits and non-ASCII characters, A-Z lower-cased) one space apart."""
    return re.sub(b"  +", b" ", (text or b"").translate(_PLAIN)).strip(b" ")


def _keywords(words: bytes, known: frozenset[bytes]) -> set[bytes]:
    out, at = set(), 0
    while at < len(words):
        end = len(words) if len(words) - at <= CHUNK else words.find(b" ", at + CHUNK)
        end = len(words) if end < 0 else end
        out |= known.intersection(words[at:end].split(b" "))
        at = end + 1
    return out


def covered(start: np.ndarray, end: np.ndarray, priority: np.ndarray) -> np.ndarray:
    """Whether each place lies within one of a stronger (smaller) priority, or within a longer one of its own.

    Of equal places of one priority the first stays.
    """
    out = np.zeros(len(start), bool)
    for p in np.unique(priority).tolist():
        own = np.flatnonzero(priority == p)
        order = own[np.lexsort((-end[own], start[own]))]
        reach = np.maximum.accumulate(end[order])
        # Those before a place start no later, and of equal starts the longer come first.
        out[order[1:]] |= reach[:-1] >= end[order[1:]]
        weaker = np.flatnonzero(priority > p)
        at = np.searchsorted(start[order], start[weaker], "right") - 1
        out[weaker] |= (at >= 0) & (reach[np.maximum(at, 0)] >= end[weaker])
    return out


def scan_text(text: bytes | None) -> tuple[int, list[tuple[str, str, int, int, float, bool]]]:
    """The number of words and the places of licences in a whole text: (label, kind, start, end, weight, base) by start.

    Places count words from 0, the end exclusive.
    """
    words = plain(text)
    if not words:
        return 0, []
    known = signatures()
    spans, of = [], []
    for k in known.worth_trying(_keywords(words, known.keywords)):
        for m in known.patterns[k].finditer(words):
            spans.append(m.span())
            of.append(k)
    n = words.count(b" ") + 1
    if not spans:
        return n, []
    place = np.array(spans)
    of = np.array(of)
    if len(spans) * len(words) < 1 << 22:
        first = np.array([words.count(b" ", 0, a) for a, _ in spans])
        last = np.array([words.count(b" ", 0, b) for _, b in spans]) + 1
    else:
        gaps = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
        first, last = np.searchsorted(gaps, place[:, 0]), np.searchsorted(gaps, place[:, 1]) + 1
    base = np.array([known.rules[k].base for k in of.tolist()])
    stays = base | ~covered(first, last, np.array([known.rules[k].priority for k in of.tolist()]))
    order = np.lexsort((of, last, first))
    out = []
    for i in order[stays[order]].tolist():
        r = known.rules[of[i]]
        out.append((r.label, r.kind, int(first[i]), int(last[i]), r.weight, r.base))
    return n, out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, n_words, found`` of every row: the words of its whole text and the licences found there.

    ``found`` holds (label, kind, start, end, weight, base) by start. A null or empty text has no words and nothing found;
    rows that repeat an id, null ids too, are rows each; an empty table gives none; other columns are not read, so their
    names may be any. A very long text is scanned whole, as one string of its words.
    """
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 12):
            got = [scan_text(t) for t in as_bytes(batch.column(1))]
            found = [[dict(zip(("label", "kind", "start", "end", "weight", "base"), x)) for x in f] for _, f in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array(found, _TYPE)], names=[id_col, "n_words", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(freed(work), f"`{id_col}` {kind}, n_words long, found {FOUND}")


def score(found: Column) -> Column:
    """How sure a text's licence is: 1 - the product over its places of (1 - weight), so it grows with every place; 0 without."""
    return F.lit(1.0) - F.aggregate(found, F.lit(1.0), lambda acc, x: acc * (F.lit(1.0) - x["weight"]))


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each scanned row: words, base places with first and last word, base labels, all labels and the score."""
    base = F.filter("found", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["start"].cast("long"))

    def labels(found: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["label"]))), ",")

    return scanned.select(
        id_col, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("found")).alias("labels"), score(F.col("found")).alias("score"),
    )

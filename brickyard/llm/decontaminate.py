"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark's items: ten consecutive words, or all words of a
shorter item. A search keeps, for blocks of two words, how far the window may be moved on
(the shift table); where no move is allowed, the bucket of the window's last two words names the
patterns that may end there, and comparing the words decides. One table is kept for each length of
pattern, so a short item does not shorten the moves for the long ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, freed, materialize, plain_words, small_batches

WINDOW = 10
#: Items whose text is sent to all tasks at once; a larger benchmark is searched in several passes.
ITEM_CHARS_AT_ONCE = 8_000_000


class WuManber:
    """All windows of ``m`` words of items that lie in one array of word numbers. ``find`` yields (start, place of the window)."""

    def __init__(self, m: int, words: np.ndarray, first: np.ndarray, size: np.ndarray):
        self.m, self.b, self.words = m, min(2, m), words
        self.far = m - self.b + 1
        # A block of an item is followed, in the window that ends soonest after it, by so many words.
        at, place = _spread(first, size - self.b + 1)
        keys, moves = self._keys(at), np.maximum(m - self.b - place, 0)
        order = np.lexsort((moves, keys))
        order = order[np.flatnonzero(np.diff(keys[order], prepend=-1))]
        self.shift = dict(zip(keys[order].tolist(), moves[order].tolist()))
        start, _ = _spread(first, size - m + 1)
        last = self._keys(start + m - self.b)
        order = np.argsort(last, kind="stable")
        self.last, self.start = last[order], start[order]

    def _keys(self, at: np.ndarray) -> np.ndarray:
        return self.words[at] << 32 | self.words[at + self.b - 1]

    def find(self, text: list[int]) -> Iterator[tuple[int, int]]:
        shift, far, back, m = self.shift, self.far, self.b - 1, self.m
        end, n = m - 1, len(text)
        while end < n:
            key = text[end - back] << 32 | text[end]
            move = shift.get(key, far)
            if move:
                end += move
                continue
            begin = end - m + 1
            window = text[begin : end + 1]
            a, b = np.searchsorted(self.last, [key, key + 1])
            for place in self.start[a:b].tolist():
                if self.words[place : place + m].tolist() == window:
                    yield begin, place
            end += 1


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first[k] + 0 ... count[k] - 1 for all k, and the numbers added."""
    added = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(first, count) + added, added


class Matcher:
    """Search tables for a set of items: (item id as text, words). About 20 bytes for each character of the items."""

    def __init__(self, items: list[tuple[str, list[bytes]]]):
        self.numbers: dict[bytes, int] = {}
        some = [(item, words) for item, words in items if words]
        self.names = [item for item, _ in some]
        size = np.array([len(words) for _, words in some], np.int64)
        flat = np.fromiter((self.numbers.setdefault(w, len(self.numbers) + 1) for _, words in some for w in words), np.int64, int(size.sum()))
        self.first = np.cumsum(size) - size
        span = np.minimum(size, WINDOW)
        self.tables = [WuManber(m, flat, self.first[span == m], size[span == m]) for m in np.unique(span).tolist()]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged (start, end) of hit words and the items found."""
        text = [self.numbers.get(w, 0) for w in words]
        found: list[tuple[int, int]] = []
        places: set[int] = set()
        for search in self.tables:
            for start, place in search.find(text):
                found.append((start, start + search.m))
                places.add(place)
        owners = np.searchsorted(self.first, sorted(places), side="right") - 1
        return _merged(found), {self.names[k] for k in owners.tolist()}


#: The tables of the part of a benchmark that this worker searched last.
_BUILT: dict[str, Matcher] = {}


def _matcher(name: str, items: list[tuple[str, list[bytes]]]) -> Matcher:
    """The search tables of the part called ``name``, made once in each worker."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Matcher(items)
    return _BUILT[name]


def _chunks(benchmark: DataFrame) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in parts of bounded size, in order of id; a part is all that the driver holds."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    part: list[tuple[str, list[bytes]]] = []
    chars = 0
    for row in items.toLocalIterator():
        part.append((row.item_id, plain_words(row.text.encode())))
        chars += len(row.text)
        if chars > ITEM_CHARS_AT_ONCE:
            yield part
            part, chars = [], 0
    if part:
        yield part


_HITS = "n_words long, hits array<struct<start:int,end:int>>, items array<string>"


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _search(state: DataFrame, items: list[tuple[str, list[bytes]]]) -> DataFrame:
    """Search one part of the items in (id, text, hits, items), adding to what is there."""
    shared, name = state.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(name, shared.value)
        for batch in batches:
            n_words, hits, items = [], [], []
            for text, before, had in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = plain_words(text)
                spans, found = matcher.hits(words)
                if before:
                    spans = _merged(spans + [(x["start"], x["end"]) for x in before])
                n_words.append(len(words))
                hits.append([{"start": a, "end": b} for a, b in spans])
                items.append(sorted(found.union(had or ())))
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(hits, span), pa.array(items, pa.list_(pa.string()))],
                ["id", "text", "n_words", "hits", "items"],
            )

    kind = state.schema["id"].dataType.simpleString()
    return state.mapInArrow(freed(work), f"id {kind}, text string, {_HITS}")


def find_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, text_col, n_words, hits, items`` for each document: merged spans of hit words and items that occur.

    Null texts have no words; null items are ignored; an empty benchmark hits nothing; repeated
    document rows are each answered. Other columns are ignored, so their names may clash with
    those made here. One pass over the documents without a shuffle while the items' text is at
    most ITEM_CHARS_AT_ONCE characters, which bounds what is sent to all tasks; beyond that one
    pass for each part of that size, each written to the shared folder before the next.
    """
    small_batches(docs.sparkSession)
    none = F.lit(None).cast("array<struct<start:int,end:int>>")
    state = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), none.alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    parts = _chunks(benchmark)
    part = next(parts, [])
    while True:
        state = _search(state, part)
        part = next(parts, None)
        if part is None:
            break
        state = materialize(state).select("id", "text", "hits", "items")
    return state.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_words", "hits", "items")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of words, hit words and items, and the hash of the items' ids, for each row."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["start"]))
    return found.select(
        id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )

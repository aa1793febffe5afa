"""How much the sources of a language differ in their words: counts behind a sketch, divergences by sparse joins.

A first pass over the texts counts in how many documents of its language each term stands, into
count-min sketches that are added up. A sketch never says less than the true number, so a term that
it puts below the least number of documents cannot be kept, and the second pass drops it before
anything is shuffled. What is left is counted exactly by (language, term, source). Two sources are
compared by the terms that both hold (a join), the terms that one holds (a histogram of its counts,
as the other's share is then one number) and the rest (a multiplication).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, freed, materialize, partitions, scratch, sendable, small_batches

#: A term is kept in a language from so many of its documents.
LEAST_DOCS = 10
#: Cells of each row of the sketch (a power of two, 2^14 at least), and rows. The merged sketch is sent as one bit a cell: 2 MB.
WIDTH, DEPTH = 1 << 22, 4
#: Cells of a piece in which sketches travel and are added up.
PIECE = 1 << 16
#: Pairs of document and distinct term that a task holds before it empties its counters.
HELD_TERMS = 2_000_000
#: Bytes of a text that are cut into terms at once.
CHUNK = 1 << 20
#: Ranks of the terms that are listed for a group.
TOP_TERMS = 10

#: A-Z fall, a-z and all bytes of 0x80 and above stay, the rest become spaces.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a whole text in order, in lists of about a CHUNK each; none for a null or empty text."""
    plain = (text or b"").translate(_LETTERS)
    at = 0
    while at < len(plain):
        end = len(plain) if len(plain) - at <= CHUNK else plain.find(b" ", at + CHUNK)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes, list[list[bytes]] | Iterator[list[bytes]]]]:
    for batch in batches:
        lang, source, text = (as_bytes(c) for c in batch.columns)
        for a, b, t in zip(lang, source, text):
            yield a or b"", b or b"", terms(t)


def cells(lang: bytes, words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Places of terms of a language in the flat sketch: an array of DEPTH rows."""
    seed = xxhash.xxh64_intdigest(lang) & 0x7FFFFFFF
    h = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))
    step = (h >> np.uint64(32)) | np.uint64(1)
    depth = np.arange(DEPTH, dtype=np.uint64)[:, None]
    return (((h + depth * step) & np.uint64(width - 1)) + depth * np.uint64(width)).astype(np.int64)


def add(sketch: np.ndarray, places: np.ndarray, counts: np.ndarray, most: int) -> None:
    """Add counts at places of a flat sketch whose cells stop at ``most``."""
    at, inverse = np.unique(places, return_inverse=True)
    sketch[at] = np.minimum(sketch[at] + np.bincount(inverse.ravel(), counts).astype(np.int64), most)


def _sketch_task(least: int, width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(DEPTH * width, np.int32)
        held: dict[bytes, Counter] = {}
        n = 0

        def empty() -> None:
            for lang, found in held.items():
                places = cells(lang, list(found), width)
                counts = np.minimum(np.fromiter(found.values(), np.int64, len(found)), least)
                add(sketch, places.ravel(), np.tile(counts, DEPTH), least)
            held.clear()

        for lang, _, chunks in _rows(batches):
            distinct: set[bytes] = set()
            for chunk in chunks:
                distinct.update(chunk)
            held.setdefault(lang, Counter()).update(distinct)
            n += len(distinct) + 1
            if n >= HELD_TERMS:
                empty()
                n = 0
        empty()
        for piece in range(0, DEPTH * width, PIECE):
            some = sketch[piece : piece + PIECE]
            at = np.flatnonzero(some)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([piece // PIECE], pa.int32()), pa.array([at.astype(np.uint16).tobytes()]), pa.array([some[at].astype(np.uint32).tobytes()])],
                    names=["piece", "at", "n"],
                )

    return work


def _merge_task(least: int):
    """Add up the pieces of a partition sorted by piece, holding one piece at a time."""

    def bits(piece: int, total: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"piece": [piece], "bits": [np.packbits(total >= least).tobytes()]})

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total = None, np.zeros(PIECE, np.int64)
        for frame in frames:
            for piece, at, n in zip(frame["piece"].tolist(), frame["at"], frame["n"]):
                if piece != now:
                    if now is not None:
                        yield bits(now, total)
                    now, total = piece, np.zeros(PIECE, np.int64)
                total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint32)
        if now is not None:
            yield bits(now, total)

    return work


def possible_cells(texts: DataFrame, least: int = LEAST_DOCS, width: int = WIDTH) -> np.ndarray:
    """One bit for each cell of the merged sketch: whether it holds ``least`` documents or more.

    ``texts``: lang, source, text. Cells count to ``least`` only, as more makes no difference. A task's sketch leaves it
    as its cells other than zero, in pieces; each piece is added up by one task. The answer has DEPTH * width bits at
    every size of the input; with more distinct terms than cells it discards less, and nothing is lost.
    """
    n = partitions(texts.sparkSession)
    pieces = texts.coalesce(n).mapInArrow(freed(_sketch_task(least, width)), "piece int, at binary, n binary")
    merged = pieces.repartition(n, "piece").sortWithinPartitions("piece").mapInPandas(freed(_merge_task(least)), "piece int, bits binary")
    out = np.zeros(DEPTH * width // 8, np.uint8)
    for row in merged.collect():
        out[row.piece * PIECE // 8 : (row.piece + 1) * PIECE // 8] = np.frombuffer(row.bits, np.uint8)
    return out


def may_pass(possible: np.ndarray, lang: bytes, words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Whether each term of a language may stand in enough documents, by the bits of the merged sketch."""
    at = cells(lang, words, width)
    return ((possible[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)


def _count_task(possible, width: int):
    """Occurrences and documents of each (lang, source, term) that may be kept."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
        n = 0

        def empty() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, docs) in held.items():
                words = list(docs)
                keep = np.flatnonzero(may_pass(possible.value, lang, words, width)).tolist()
                for k in range(0, len(keep), 1 << 16):
                    some = [words[i] for i in keep[k : k + (1 << 16)]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(some), pa.binary()).cast(pa.string()), pa.array([source] * len(some), pa.binary()).cast(pa.string()),
                            pa.array(some, pa.binary()).cast(pa.string()), pa.array([times[w] for w in some], pa.int64()), pa.array([docs[w] for w in some], pa.int64()),
                        ],
                        names=["lang", "source", "term", "n", "docs"],
                    )
            held.clear()

        for lang, source, chunks in _rows(batches):
            times, docs = held.setdefault((lang, source), (Counter(), Counter()))
            distinct: set[bytes] = set()
            for chunk in chunks:
                times.update(chunk)
                distinct.update(chunk)
            docs.update(distinct)
            n += len(distinct) + 1
            if n >= HELD_TERMS:
                yield from empty()
                n = 0
        yield from empty()

    return work


def kept_counts(texts: DataFrame, least: int = LEAST_DOCS, width: int = WIDTH) -> DataFrame:
    """``lang, source, term, n, lang_n, first``: exact occurrences of each kept term in each source that holds it.

    ``lang_n`` is the term's number in the whole language; ``first`` marks one row of each term. ``texts``: lang, source,
    text without nulls in the first two. A (lang, term) has at most as many rows as there are sources.
    """
    spark = texts.sparkSession
    possible = spark.sparkContext.broadcast(possible_cells(texts, least, width))
    some = texts.mapInArrow(freed(_count_task(possible, width)), "lang string, source string, term string, n long, docs long")
    counted = some.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    whole = counted.select(
        "lang", "source", "term", "n", F.sum("n").over(w).alias("lang_n"), F.sum("docs").over(w).alias("all_docs"), (F.min("source").over(w) == F.col("source")).alias("first")
    )
    return whole.where(F.col("all_docs") >= least).drop("all_docs")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 * size)), by long division in steps of a thousand, so that no product overflows."""
    over = total + 2 * size
    out, rest = _div(count + 2, over), (count + 2) % over
    for _ in range(3):
        out, rest = out * 1000 + _div(rest * 1000, over), (rest * 1000) % over
    return out + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)): the term's part of a divergence; the same both ways."""
    return _div((p - q) * (p - q), p + q)


def _groups(texts: DataFrame, kept: DataFrame) -> DataFrame:
    """Every (lang, source) with its number of kept occurrences, the language's, the language's kept terms and the share of no occurrence."""
    per_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("first").cast("long")).alias("firsts"))
    per_lang = per_group.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("firsts").alias("size"))
    zero = F.lit(0).cast("long")
    out = (
        texts.select("lang", "source").distinct().join(per_group.drop("firsts"), ["lang", "source"], "left").join(per_lang, "lang", "left")
        .select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("total", "lang_total", "size")))
    )
    return out.withColumn("none", F.when(F.col("size") > 0, share(zero, F.col("total"), F.col("size"))))


def _named(df: DataFrame, tag: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.toDF(*(c if c in keep else f"{c}_{tag}" for c in df.columns))


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for every two sources of a language, both ways."""
    n = partitions(kept.sparkSession)
    few = sendable(groups)
    rated = kept.join(few, ["lang", "source"]).select("lang", "term", "source", share(F.col("n"), F.col("total"), F.col("size")).alias("p"), "none")
    a, b = _named(rated, "a", ("lang", "term")), _named(rated, "b", ("lang", "term"))
    both = (
        a.join(b, ["lang", "term"]).where("source_a < source_b").groupBy("lang", "source_a", "source_b")
        .agg(F.sum(gap(F.col("p_a"), F.col("p_b")) - gap(F.col("p_a"), F.col("none_b")) - gap(F.col("none_a"), F.col("p_b")) + gap(F.col("none_a"), F.col("none_b"))).alias("both"))
    )
    spread = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("k")).join(few, ["lang", "source"])
    own = spread.select("lang", "source", "k", share(F.col("n"), F.col("total"), F.col("size")).alias("p"), "none")
    others = _named(few.select("lang", "source", "none"), "b", ("lang",))
    side = (
        _named(own, "a", ("lang", "k")).join(others, "lang").where("source_a <> source_b")
        .groupBy("lang", F.least("source_a", "source_b").alias("source_a"), F.greatest("source_a", "source_b").alias("source_b"))
        .agg(F.sum(F.col("k") * (gap(F.col("p_a"), F.col("none_b")) - gap(F.col("none_a"), F.col("none_b")))).alias("side"))
    )
    two = (
        _named(groups.select("lang", "source", "none", "size"), "a", ("lang", "size")).repartition(n, "lang", "source_a")
        .join(others, "lang").where("source_a < source_b")
        .join(both, ["lang", "source_a", "source_b"], "left").join(side, ["lang", "source_a", "source_b"], "left")
    )
    zero = F.lit(0).cast("long")
    plain = F.when(F.col("size") > 0, F.col("size") * gap(F.col("none_a"), F.col("none_b"))).otherwise(zero)
    value = plain + F.coalesce("both", zero) + F.coalesce("side", zero)
    ways = F.array(*(F.struct(F.col(f"source_{x}").alias("source"), F.col(f"source_{y}").alias("item")) for x, y in ("ab", "ba")))
    return two.select("lang", value.alias("value"), F.explode(ways).alias("way")).select("lang", "way.source", "way.item", "value")


def _standing_out(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of the kept terms that a source holds more of than its language."""
    rated = kept.join(sendable(groups), ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("total"), F.col("size")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("size")).alias("q")
    )
    return rated.where("p > q").select("lang", "source", "item", gap(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS, width: int = WIDTH) -> DataFrame:
    """``lang, source, part, item, value, rank``: how each source differs from the others of its language.

    Part ``pair`` lists every other source of the language with the divergence over all kept terms (those in at least
    ``least`` documents of the language); part ``term`` the ``top`` kept terms that the source holds more of than the
    whole language. Ranks go by value, then by the item's bytes. ``docs``: text, lang, source; other columns are not
    read. Nulls are empty strings, so a null and an empty language are one. A text without terms counts for nothing, but
    its source is listed; a source alone in its language has no pairs; rows that repeat a document count again; an empty
    table gives no rows. A text of any length is cut into terms in chunks; its distinct terms are held at once. The answer
    has a row for every two sources of a language, and both ways a term's sources meet in one join, so cost
    grows with the square of the number of sources; it does not with that of documents.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    with scratch():
        kept = materialize(kept_counts(texts, least, width))
        groups = materialize(_groups(texts, kept))
        ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

        def part(rows: DataFrame, name: str) -> DataFrame:
            return rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))

        return materialize(part(_pairs(kept, groups), "pair").union(part(_standing_out(kept, groups), "term").where(F.col("rank") <= top)), keep=True)

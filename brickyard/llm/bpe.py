"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Encoding works on blocks of documents (about one and a half million characters). Every block is cut into
pre-tokens with their positions, and each distinct pre-token ("word") of a block travels once, in
packed rows keyed by a hash bucket of the word. The task of a bucket sees each word of the corpus
that falls there, encodes it once, and sends the ids back to the blocks. There the ids are put at
the positions the words were taken from. Rows that travel: the words of each block, their ids, and
one sequence of word numbers for each block; never a row for each token.

A block is a run of rows of an input partition, so the input must come in the same order when a
task is repeated: a table scan does, and anything else should be written first. A checksum of the
words of each block and bucket, made where they were encoded, is compared with that of the words
whose positions were taken; a difference raises, it never gives wrong ids.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, give_back, partitions, slices, small_batches

#: Characters in a block; a longer document is a block of its own.
BLOCK_CHARS = 1_500_000
#: Bytes of words that a task of a bucket remembers with their ids; beyond it starts anew.
KNOWN_BYTES = 16_000_000
#: Characters, tokens or ids that arrays are made over at a time (at least one document or row), as they take many bytes for each.
PIECE = 1 << 17

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: base64 of the token's bytes and its id on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def _encoder(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(1)
def _classes() -> np.ndarray:
    codes = np.concatenate([np.arange(0xD800, dtype="<u4"), np.arange(0xE000, 0x110000, dtype="<u4")])
    every = codes.tobytes().decode("utf-32-le")
    out = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[codes[m.start() : m.end()]] = kind
    return out


def cut(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts joined, and the starts of their pre-tokens and of the documents (with the end).

    The same cuts as public_tokenizers.PATTERN makes in each text alone, found with array
    operations over the classes of characters: runs of letters, numbers, others and white space;
    a blank goes with the run it precedes, the last character of white space stands alone before
    a word, and the seven English contractions follow an apostrophe that starts a pre-token.
    """
    whole = "".join(texts)
    ends = np.cumsum([0, *map(len, texts)])
    code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    n = len(code)
    if not n:
        return whole, np.zeros(0, np.int64), ends
    kind = np.empty(n, np.uint8)
    for a in range(0, n, 1 << 18):  # in pieces, as a whole index would be widened to eight bytes a character
        kind[a : a + (1 << 18)] = _classes()[code[a : a + (1 << 18)]]
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    start = edge[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(start)
    stop = np.append(at[1:], n)
    spaces = (kind[at] == _SPACE) & ~edge[stop]  # white space with a word after it in its text
    last = stop[spaces] - 1
    start[last] = True
    blank = last[code[last] == 32]
    start[blank + 1] = False
    # Contractions.
    quote = at[(code[at] == 39) & (stop - at == 1) & (kind[at] == _OTHER) & ~edge[stop]]
    quote = quote[start[quote] & (kind[np.minimum(quote + 1, n - 1)] == _LETTER)]
    if len(quote):
        one = code[quote + 1]
        inside = (quote + 2 < n) & ~edge[np.minimum(quote + 2, n)]
        two = np.where(inside, code[np.minimum(quote + 2, n - 1)], 0)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for hit, width in ((single, 2), (double & ~single, 3)):
            q = quote[hit]
            start[q + 1] = False
            after = q + width
            after = after[after < n]
            start[after] = True
    return whole, np.flatnonzero(start), ends


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[str]]]:
    """(block number, ids, texts): runs of rows of at most BLOCK_CHARS characters, or one row."""
    block: int | None = None
    ids: list = []
    texts: list[str] = []
    chars = 0
    for batch in slices(batches, 1_000):
        if block is None and len(batch):
            block = batch.column(2)[0].as_py() << 32
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            if texts and chars + len(text) > BLOCK_CHARS:
                yield block, ids, texts
                block, ids, texts, chars = block + 1, [], [], 0
            ids.append(i)
            texts.append(text)
            chars += len(text)
    if texts:
        yield block, ids, texts


def _runs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Start and end of runs of items whose sizes come to PIECE at most, or of one item."""
    a, n = 0, 0
    for k, size in enumerate(sizes):
        if k > a and n + size > PIECE:
            yield a, k
            a, n = k, 0
        n += size
    if sizes:
        yield a, len(sizes)


def _words(texts: list[str]) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """The distinct words in order of appearance, the word number of each token, tokens by document."""
    number: dict[str, int] = {}
    seqs, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for i, j in _runs([*map(len, texts)]):
        whole, at, ends = cut(texts[i:j])
        seq = np.empty(len(at), np.uint32)
        for k in range(0, len(at), 1 << 16):
            cuts = [*at[k : k + (1 << 16) + 1].tolist(), len(whole)][: min(1 << 16, len(at) - k) + 1]
            seq[k : k + (1 << 16)] = [number.setdefault(whole[a:b], len(number)) for a, b in zip(cuts, cuts[1:])]
        seqs.append(seq)
        sizes.append(np.diff(np.searchsorted(at, ends)))
    return number, np.concatenate(seqs), np.concatenate(sizes)


def _checksum(crcs: np.ndarray) -> int:
    """Of words in order, by their own checksums (unsigned 32-bit)."""
    return zlib.crc32(crcs.tobytes()) << 24 ^ len(crcs)


def _crcs(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


def _planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers by byte, all lowest bytes first, which compresses well."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(data: bytes, n: int, at: int) -> np.ndarray:
    """The n numbers whose planes start at ``at``."""
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").reshape(-1)


def _pack_words(words: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, words), np.uint32, len(words))
    return zstandard.compress(len(words).to_bytes(4, "little") + _planes(sizes) + b"".join(words), 3)


def _unpack_words(data: bytes) -> list[bytes]:
    raw = zstandard.decompress(data)
    n = int.from_bytes(raw[:4], "little")
    ends = (4 + 4 * n + np.cumsum(_numbers(raw, n, 4), dtype=np.int64)).tolist()
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends], ends)]


def _pack_ids(ids: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, ids), np.uint32, len(ids)) // np.uint32(4)
    return zstandard.compress(len(ids).to_bytes(4, "little") + _planes(sizes) + _planes(np.frombuffer(b"".join(ids), np.uint32)), 3)


def _unpack_ids(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each word has, and all ids."""
    raw = zstandard.decompress(data)
    n = int.from_bytes(raw[:4], "little")
    sizes = _numbers(raw, n, 4)
    return sizes, _numbers(raw, int(sizes.sum()), 4 + 4 * n)


_ROW = "block long, bucket int, check long, payload binary"


def _send_words(buckets: int):
    def rows(block: int, texts: list[str]) -> pa.RecordBatch:
        parts: list[list[bytes]] = [[] for _ in range(buckets)]
        for w in map(str.encode, _words(texts)[0]):
            parts[zlib.crc32(w) % buckets].append(w)
        return _batch([(block, k, 0, _pack_words(part)) for k, part in enumerate(parts) if part])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, texts in _blocks(batches):
            yield rows(block, texts)

    return work


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [*zip(*rows)] if rows else [()] * 4
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["block", "bucket", "check", "payload"])


def _encode_words(path: str, pattern: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        known: dict[bytes, bytes] = {}
        room = KNOWN_BYTES
        for batch in batches:
            for block, bucket, _, payload in zip(*(c.to_pylist() for c in batch.columns)):
                words, ids = _unpack_words(payload), []
                for w in words:
                    if (x := known.get(w)) is None:
                        x = np.array(encoder.encode_ordinary(w.decode()), np.uint32).tobytes()
                        if (room := room - len(w) - len(x) - 150) < 0:
                            known.clear()
                            room = KNOWN_BYTES
                        known[w] = x
                    ids.append(x)
                yield _batch([(block, bucket, _checksum(_crcs(words)), _pack_ids(ids))])

    return work


def _send_positions(buckets: int):
    def row(block: int, ids: list, texts: list[str]) -> pa.RecordBatch:
        number, seq, sizes = _words(texts)
        crcs = _crcs([w.encode() for w in number])
        # The word numbers of each bucket, and their checksum, in order of bucket.
        part = crcs % np.uint32(buckets)
        order = np.argsort(part, kind="stable")
        edge = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1).astype(bool)) if len(part) else np.zeros(1, np.int64)
        checks = [_checksum(crcs[order[a:b]]) for a, b in zip(edge, edge[1:])]
        known = np.array([i is not None for i in ids], np.uint8)
        parts = [
            np.array([len(ids), len(part), len(seq), len(checks)], np.int64).tobytes(), known.tobytes(), np.array([i or 0 for i in ids], np.int64).tobytes(),
            np.array(checks, np.int64).tobytes(), _planes(sizes), _planes(part), _planes(seq),
        ]
        return _batch([(block, -1, 0, zstandard.compress(b"".join(parts), 3))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in _blocks(batches):
            yield row(block, ids, texts)

    return work


_DIFFER = "a block's words differ between two reads of the input; write it to a table first"


def _assemble(frame: pd.DataFrame) -> pd.DataFrame:
    out = _assembled(frame)
    give_back()
    return out


def _assembled(frame: pd.DataFrame) -> pd.DataFrame:
    whole = frame[frame.bucket < 0]
    if len(whole) != 1:
        raise RuntimeError(_DIFFER)
    raw = zstandard.decompress(whole.payload.iloc[0])
    n, v, t, c = np.frombuffer(raw, np.int64, 4).tolist()
    at = 32
    known = np.frombuffer(raw, np.uint8, n, at).astype(bool)
    ids = np.frombuffer(raw, np.int64, n, at := at + n)
    checks = np.frombuffer(raw, np.int64, c, at := at + 8 * n)
    sizes = _numbers(raw, n, at := at + 8 * c).astype(np.int64)
    part = _numbers(raw, v, at := at + 4 * n)
    seq = _numbers(raw, t, at + 4 * v)
    got = {b: (check, payload) for b, check, payload in zip(frame.bucket, frame.check, frame.payload) if b >= 0}
    there = np.unique(part).tolist()
    if sorted(got) != there or any(got[b][0] != check for b, check in zip(there, checks.tolist())):
        raise RuntimeError(_DIFFER)
    width, flats = np.zeros(v, np.int64), []
    first = np.zeros(v, np.int64)
    done = 0
    order = np.argsort(part, kind="stable")
    for b, mine in zip(there, np.split(order, np.searchsorted(part[order], there)[1:])):
        count, flat = _unpack_ids(got[b][1])
        width[mine] = count
        first[mine] = done + np.cumsum(count, dtype=np.int64) - count
        done += len(flat)
        flats.append(flat)
    flat = np.concatenate(flats) if flats else np.zeros(0, np.uint32)
    del raw, got, flats
    # Token k of the block takes ids first[seq[k]] ... + width[seq[k]]; written at its position.
    out = np.empty(int(np.bincount(seq, minlength=v) @ width), np.uint32)
    ends = np.cumsum(sizes)
    bound = np.zeros(n + 1, np.int64)
    done = 0
    for a in range(0, t, PIECE):
        some = seq[a : a + PIECE]
        count = width[some]
        stop = np.cumsum(count)
        out[done : done + stop[-1]] = flat[np.repeat(first[some] - (stop - count), count) + np.arange(stop[-1])]
        i, j = np.searchsorted(ends, [a, a + PIECE], side="right")
        bound[1 + i : 1 + j] = done + stop[ends[i:j] - a - 1]
        done += int(stop[-1])
    data = memoryview(out).cast("B")
    return pd.DataFrame({
        "id": pd.array(np.where(known, ids, 0), "Int64").copy() if known.all() else pd.array([i if k else None for i, k in zip(ids.tolist(), known)], "Int64"),
        "n_tokens": np.diff(bound),
        "ids": [bytes(data[4 * a : 4 * b]) for a, b in zip(bound.tolist(), bound[1:].tolist())],
    })


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit) for each row of ``docs``.

    Null and empty texts have no ids; a null id stays null; repeated rows give repeated rows; other
    columns are ignored whatever their names; an empty table gives none. Whole texts are encoded,
    however long. ``docs`` is read twice and must be a table scan (see the module's text).
    """
    spark = docs.sparkSession
    small_batches(spark)
    buckets = partitions(spark)
    pair = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("part"))
    words = pair.mapInArrow(freed(_send_words(buckets)), _ROW)
    ids = words.repartition(buckets, "bucket").mapInArrow(freed(_encode_words(path, pattern)), _ROW)
    rows = ids.union(pair.mapInArrow(freed(_send_positions(buckets)), _ROW))
    out = rows.groupBy("block").applyInPandas(_assemble, "id long, n_tokens long, ids binary")
    return out.withColumnRenamed("id", id_col)


def _bytes(tokens: pa.Array, column: list[bytes | None]) -> pa.Array:
    ids = np.frombuffer(b"".join(x or b"" for x in column), np.uint32)
    bound = np.cumsum([0, *(len(x or b"") // 4 for x in column)])
    taken = pc.take(tokens, pa.array(ids))
    if taken.null_count:
        raise IndexError("an id is not in the vocabulary")
    offsets = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, taken.offset * 8) if len(taken) else np.zeros(1, np.int64)
    data = memoryview(taken.buffers()[2] or b"") if len(taken) else memoryview(b"")
    at = offsets[bound].tolist()
    return pa.array([None if x is None else bytes(data[a:b]) for x, a, b in zip(column, at, at[1:])], pa.binary())


def _take_tokens(path: str, names: list[str], where: int, into: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = {i: b for b, i in ranks(path).items()}
        tokens = pa.array([by_id.get(i) for i in range(max(by_id) + 1)], pa.large_binary())
        for batch in batches:
            for a, b in _runs([(n or 0) // 4 for n in pc.binary_length(batch.column(where)).to_pylist()]):
                some = batch.slice(a, b - a)
                kept = [(n, c) for n, c in zip(names, some.columns) if n != into]
                out = _bytes(tokens, some.column(where).to_pylist())
                yield pa.record_batch([*(c for _, c in kept), out], [*(n for n, _ in kept), into])

    return work


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """Add ``into``: the bytes of each row's ids, joined with the table of token bytes.

    The table has one row for each rank, so its size is bound by the vocabulary; each task reads it
    from the rank file and takes the ids of a run of rows from it at once. Null ids give null; an id
    that is not in the vocabulary raises IndexError.
    """
    names = [f.name for f in encoded.schema.fields]
    where = names.index(ids_col)
    schema = encoded.drop(into).schema.add(into, "binary")
    return encoded.mapInArrow(freed(_take_tokens(path, names, where, into)), schema)

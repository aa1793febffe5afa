"""Exact Jaccard join of documents by word shingles, with count-vector R-trees.

A document is the set of its distinct five-word shingles (64-bit hashes). Hashing the shingles
into groups and counting gives it a point; the overlap of two sets is at most the sum over the
groups of the smaller count, and for a box of points at most the sum of minima with the box's upper
corner. An R-tree over such points so finds all pairs that may overlap enough, and comparing the
sets decides.

One tree over a corpus would be probed by every document, which is quadratic. The trees are
therefore built in shards that lose no pair: put all shingles in one order and two sets of
similarity 0.75 share one of the first n - ceil(0.75 n) + 1 shingles of each. Each such shingle
names a shard. The order is free; the commonest shingles, counted over all documents, come
last, so passages that very many documents share name no shards but for documents made of little
else. Shingles that no other set has (nearly all) are gone after the first shuffle.

Copies are handled before pairs: equal sets are one class from the start, and classes whose
min-hashes agree are compared in blocks of bounded size and joined. The trees then look only for
links between different components, which is all that is left to find. They are searched twice: at
first each component of a shard names its best pair only, so that what leaves a shard grows with
its members; these are verified and joined, and then every pair of what is still apart is tried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, by_sorted_group, cuts, dealt, Forest, freed, materialize, mix64, scratch, sendable, slices, small_batches, whole_groups
from .components import connected_components

WORDS = 5
#: Hash groups of shingles, the coordinates of a point.
GROUPS = 512
#: Common shingles that come last in the order, at most; the driver holds them, the tasks a table of flags.
COMMON = 262_144
#: Sets in a block of the comparison of min-hash classes, and points of a shard handled together.
BLOCK, CELL = 384, 4_096
LEAF = 16
#: Pairs of two components that are compared first; once joined, the rest need no look.
TRIES = 64

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: A random 64-bit number for each byte, lower-cased (A-Z only).
_BYTE = mix64(np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64) + np.uint64(1))
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes of text whose shingles are made together; a longer text is a batch of its own.
BATCH_BYTES = 400_000
#: Documents of a batch that are held as sets at once.
BATCH_ROWS = 2_500


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def shingle_batch(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all texts in order, as 64-bit hashes, and how many each text has.

    A shingle is WORDS consecutive words, or all words of a text of fewer; words are runs of
    anything but ASCII white space, A-Z lower-cased. A word's hash is a polynomial over random
    numbers of its bytes, taken from prefix sums modulo 2^64 for all words at once.
    """
    sizes = np.array([len(t or b"") for t in texts], np.int64)
    data = np.frombuffer(b" ".join(t or b"" for t in texts) + b" ", np.uint8)
    edge = np.concatenate([[0], np.cumsum(sizes + 1)])
    space = _SPACE[data]
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    last = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers(_BASE, len(data)))])
    words = mix64((sums[last] - sums[first]) * _powers(_INVERSE, len(data))[first] + (last - first).astype(np.uint64))
    bound = np.searchsorted(first, edge)
    n = np.diff(bound)
    whole = np.full(max(0, len(words) - WORDS + 1), WORDS, np.uint64)
    for k in range(WORDS):
        whole = whole * _FACTOR + words[k : len(words) - WORDS + 1 + k]
    whole = mix64(whole)
    out, count = [], np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    for a, k, c in zip(bound.tolist(), n.tolist(), count.tolist()):
        if k >= WORDS:
            out.append(whole[a : a + c])
        elif k:
            h = np.full(1, k, np.uint64)
            for w in words[a : a + k]:
                h = h * _FACTOR + w
            out.append(mix64(h))
    return np.concatenate(out), count


def sequences(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """The shingles of each text in order."""
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b] or b"") <= BATCH_BYTES):
            size += len(texts[b] or b"")
            b += 1
        flat, count = shingle_batch(texts[a:b])
        yield from np.split(flat, np.cumsum(count)[:-1])
        a = b


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    for s in sequences(texts):
        s = np.sort(s)
        if len(s) > 1:
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            s = s[keep]
        yield s


def _signature(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set size and signature of each document, and the common shingles of each batch with their counts."""
    for batch in slices(batches, 2 * BATCH_ROWS):
        sets = [*shingle_sets(as_bytes(batch.column(1)))]
        signs = [_signature(s) for s in sets]
        values, counts = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_counts=True)
        some = np.flatnonzero(counts >= 2)
        some = some[np.argsort(-counts[some], kind="stable")[:COMMON // 4]]
        n, m = len(sets), len(some)
        pad = lambda x, after: pa.array([*x, *[None] * m] if after else [*[None] * n, *x], pa.int64())
        yield pa.record_batch(
            [pa.concat_arrays([batch.column(0).cast(pa.int64()), pa.nulls(m, pa.int64())]), pad(map(len, sets), True), pad((a for a, _ in signs), True), pad((b for _, b in signs), True), pad(values[some].view(np.int64).tolist(), False), pad(counts[some].tolist(), False), pa.concat_arrays([batch.column(2), pa.nulls(m, pa.int64())])],
            ["id", "n", "s1", "s2", "shingle", "times", "hash"],
        )


#: Bits of a shingle that pick its flag in the table of common ones (one byte each, 2 MB in all).
FLAG_BITS = 21


def flags(common: np.ndarray) -> np.ndarray:
    """Table of flags of the common shingles. One that shares a flag with a common one counts as common too."""
    out = np.zeros(1 << FLAG_BITS, bool)
    out[(common >> np.uint64(64 - FLAG_BITS)).astype(np.int64)] = True
    return out


def prefix(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.75 n) + 1 of a set, by hash, those with a flag in ``common`` last."""
    n = len(s)
    size = n - (3 * n + 3) // 4 + 1 if n else 0
    last = common[(s >> np.uint64(64 - FLAG_BITS)).astype(np.int64)]
    if last[:size].any():
        s = np.concatenate([s[~last], s[last]])
    return s[:size]


def _keys(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in slices(batches, BATCH_ROWS):
            done: set[int] = set()
            keys, owners = [], []
            for s in shingle_sets(as_bytes(batch.column(0))):
                if not len(s) or (own := _signature(s)[0]) in done:
                    continue
                done.add(own)
                keys.append(prefix(s, common))
                owners.append(own)
            if keys:
                flat = np.concatenate(keys).view(np.int64)
                yield pa.record_batch([pa.array(flat), pa.array(np.repeat(np.array(owners, np.int64), [len(k) for k in keys]))], ["key", "s1"])

    return work


def point(s: np.ndarray) -> bytes:
    """Counts of a set's shingles by hash group, one byte each; 255 stands for any larger count."""
    return np.minimum(np.bincount((s >> np.uint64(40)) % np.uint64(GROUPS), minlength=GROUPS), 255).astype(np.uint8).tobytes()


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, min-hashes and count vectors of each class that a task meets."""
    seeds = np.array([0x5851F42D4C957F2D, 0x14057B7EF767814F], np.uint64)
    done: set[int] = set()
    for batch in slices(batches, BATCH_ROWS):
        rows = []
        for s in shingle_sets(as_bytes(batch.column(0))):
            if len(s) and (own := _signature(s)[0]) not in done:
                done.add(own)
                mins = (int(mix64(s ^ k).min().view(np.int64)) for k in seeds)
                rows.append((own, len(s), *mins, point(s)))
        columns = [*zip(*rows)] if rows else [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["s1", "n", "m0", "m1", "point"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each class that a task meets."""
    done: set[int] = set()
    for batch in slices(batches, BATCH_ROWS):
        rows = []
        for s in shingle_sets(as_bytes(batch.column(0))):
            if len(s) and (own := _signature(s)[0]) not in done:
                done.add(own)
                rows.append((own, len(s), s.tobytes()))
        columns = [*zip(*rows)] if rows else [()] * 3
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.binary()])], ["s1", "n", "shingles"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a block of sets, as a product of incidence matrices."""
    values, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = counts > 1
    number = np.cumsum(shared) - 1
    keep = shared[at]
    column, owner = number[at[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for a in range(0, int(shared.sum()), 8192):
        i, j = np.searchsorted(column, [a, a + 8192])
        m = np.zeros((len(sets), 8192), np.float32)
        m[owner[i:j], column[i:j] - a] = 1
        out += (m @ m.T).astype(np.int64)
    return out


def _join_block(frame: pd.DataFrame) -> pd.DataFrame | None:
    if len(frame) < 2:
        return None
    n = frame.n.to_numpy()
    both = overlaps([np.frombuffer(s, np.uint64) for s in frame.shingles])
    a, b = np.nonzero(np.triu(7 * both >= 3 * (n[:, None] + n[None, :]), 1))
    trees = Forest(len(frame))
    kept = [(i, j) for i, j in zip(a.tolist(), b.tolist()) if trees.join(i, j)]
    if not kept:
        return None
    ids = frame.s1.to_numpy()
    i, j = np.array(kept).T
    return pd.DataFrame({"a": ids[i], "b": ids[j]})


class CountTree:
    """A packed R-tree over count vectors; nodes keep their upper corners, smallest set size and first and last component."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, of: np.ndarray):
        self.order = self._sorted(points, sizes)
        self.points, self.sizes, self.of = points[self.order], sizes[self.order], of[self.order]
        self.levels = []
        level = (self.points, self.sizes, self.of, self.of)
        while len(level[0]) > LEAF:
            at = np.arange(0, len(level[0]), LEAF)
            level = tuple(f.reduceat(x, at) for f, x in zip((np.maximum, np.minimum, np.minimum, np.maximum), level))
            self.levels.append(level)

    @staticmethod
    def _sorted(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Bulk loading: split at the median of the coordinate that spreads most until a leaf is full."""
        out, todo = [], [np.argsort(sizes, kind="stable")]
        while todo:
            part = todo.pop()
            if len(part) <= LEAF:
                out.append(part)
                continue
            own = points[part]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            part = part[np.argsort(own[:, axis], kind="stable")]
            half = max(LEAF, len(part) // 2 // LEAF * LEAF)
            todo += [part[half:], part[:half]]
        return np.concatenate(out)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All pairs (each once) of points of different components that may link, with their bounds, some at a time."""
        count = [len(self.points), *(len(level[0]) for level in self.levels)]
        for a in range(0, len(self.points), 256):
            q = np.arange(a, min(a + 256, len(self.points)))
            i, node = np.repeat(q, count[-1]), np.tile(np.arange(count[-1]), len(q))
            for k in range(len(self.levels) - 1, -1, -1):
                top, least, low, high = self.levels[k]
                good = ((low[node] != high[node]) | (low[node] != self.of[i])) & ((node + 1) * LEAF ** (k + 1) > i)
                i, node = i[good], node[good]
                good = bounds(self.points, i, top, node, self.sizes[i] + least[node]) >= 0
                i, node = np.repeat(i[good], LEAF), (node[good, None] * LEAF + np.arange(LEAF)).reshape(-1)
                inside = node < count[k]
                i, node = i[inside], node[inside]
            good = (node > i) & (self.of[i] != self.of[node])
            i, node = i[good], node[good]
            bound = bounds(self.points, i, self.points, node, self.sizes[i] + self.sizes[node])
            good = bound >= 0
            yield self.order[i[good]], self.order[node[good]], bound[good]


def bounds(p: np.ndarray, i: np.ndarray, q: np.ndarray, j: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Summed minima of p[i] and q[j] as a share of ``total``, the sets' sizes; -1 where no similarity of 0.75 is possible.

    A count of 255 stands for any larger one, so where both are 255 nothing is bounded.
    """
    out = np.empty(len(i))
    for a in range(0, len(i), 8_192):
        low = np.minimum(p[i[a : a + 8_192]], q[j[a : a + 8_192]])
        whole = total[a : a + 8_192]
        bound = np.where((low == 255).any(axis=1), whole, low.sum(axis=1, dtype=np.int64))
        out[a : a + 8_192] = np.where(7 * bound >= 3 * whole, bound / whole, -1)
    return out


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pd.DataFrame:
    """Distinct pairs, the lesser first."""
    both = np.sort(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=1)
    both = np.unique(both, axis=0)
    return pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})


def _near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of different components in shards of a leaf or less whose sizes let them link."""
    for f in whole_groups(frames, ["key"]):
        key, n, c, s = (f[x].to_numpy() for x in ("key", "n", "c", "s1"))
        a, b = [s[:0]], [s[:0]]
        for step in range(1, LEAF):
            x, y = n[step:], n[:-step]
            i = np.flatnonzero((key[step:] == key[:-step]) & (c[step:] != c[:-step]) & (4 * np.minimum(x, y) >= 3 * np.maximum(x, y)))
            a.append(s[i])
            b.append(s[i + step])
        yield _pairs(a, b)


def _candidates(all_pairs: bool):
    """Pairs of different components in each larger shard that the tree leaves: of each component the best one, or all."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in whole_groups(frames, ["key", "x", "y"]):
            at = cuts(f, ["key", "x", "y"]).tolist()
            points = np.frombuffer(b"".join(f.point), np.uint8).reshape(-1, GROUPS)
            n, c, s = f.n.to_numpy(), f.c.to_numpy(), f.s1.to_numpy()
            first, second = [s[:0]], [s[:0]]
            for a, b in zip(at, at[1:]):
                _, of = np.unique(c[a:b], return_inverse=True)
                best: dict[int, tuple[float, int, int]] = {}
                for i, j, bound in CountTree(points[a:b], n[a:b], of).pairs():
                    if all_pairs:
                        first.append(s[a + i])
                        second.append(s[a + j])
                        continue
                    owner, x, y, share = np.concatenate([of[i], of[j]]), np.tile(i, 2), np.tile(j, 2), np.tile(bound, 2)
                    order = np.lexsort((-share, owner))
                    top = order[np.flatnonzero(np.diff(owner[order], prepend=-1))]
                    for o, e, k, m in zip(owner[top].tolist(), share[top].tolist(), x[top].tolist(), y[top].tolist()):
                        if o not in best or e > best[o][0]:
                            best[o] = (e, k, m)
                if best:
                    _, i, j = (np.array(v) for v in zip(*best.values()))
                    first.append(s[a + i])
                    second.append(s[a + j])
            yield _pairs(first, second)

    return work


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            at = np.searchsorted(x, y)
            both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
            good.append(100 * both >= 75 * (len(x) + len(y) - both))
        yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, GROUPS) for c in batch.columns[2:4])
        n, m = (c.to_numpy(zero_copy_only=False) for c in batch.columns[4:6])
        at = np.arange(len(x))
        yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(bounds(x, at, y, at, n + m) >= 0))


def _named(labels: DataFrame | None, nodes: DataFrame) -> DataFrame:
    """Each node (s1) with its component so far, c."""
    if labels is None:
        return nodes.withColumn("c", F.col("s1"))
    return nodes.join(labels.select(F.col("node").alias("s1"), "component"), "s1", "left").withColumn("c", F.coalesce("component", "s1")).drop("component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id, group_id, text_hash`` (xxhash64 of the text) for each row of ``docs``.

    Two rows link when 100 * intersection >= 75 * union of their sets; component_id is the
    smallest id reachable, itself included. Null texts and texts without words have no shingles
    and link with nothing; a null id is answered with a null component and links with nothing;
    rows that repeat an id are answered each for its own text, and group_id tells groups apart that such an id names alike
    (null where there is none); other columns are ignored, and an
    empty table gives no rows. Whole texts count, however long. Sets are compared by 64-bit
    hashes of shingles; no pair is left out by sampling, and no group of copies is listed in pairs.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pair = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    hashed = pair.withColumn("hash", F.xxhash64("text"))
    first = materialize(hashed.mapInArrow(freed(_first_pass), "id long, n long, s1 long, s2 long, shingle long, times long, hash long"), keep=True)
    rows = first.where("s1 is not null").select("id", "n", "s1", "s2", "hash")
    often = first.where("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times"))
    common = often.where("times >= 6").orderBy(F.desc("times"), "shingle").limit(COMMON).select("shingle").toArrow()
    last = flags(common.column(0).to_numpy().astype(np.int64).view(np.uint64))
    classes = rows.where("n > 0 and id is not null").groupBy("s1", "s2").agg(F.min("id").alias("rep"))
    with scratch():
        component = _components(spark, pair, classes, last)
        named = _named(component, classes.select("s1", "s2", "rep")).withColumn("component_id", F.min("rep").over(Window.partitionBy("c")))
        of_class = materialize(named.select("s1", "s2", "c", "component_id"), keep=True)
    out = rows.join(of_class, ["s1", "s2"], "left")
    lone = F.col("n").isNull() | (F.col("n") == 0)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(lone, F.col("id")).when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"), F.col("c").alias("group_id"), F.col("hash").alias("text_hash"))


def _components(spark: SparkSession, pair: DataFrame, classes: DataFrame, common: np.ndarray) -> DataFrame:
    """``node, component`` of classes of equal sets, by verified links that connect each component; classes that share no shard are left out."""
    keys = pair.where("id is not null").select("text").mapInArrow(freed(_keys(spark.sparkContext.broadcast(common))), "key long, s1 long")
    same = Window.partitionBy("key")
    shared = materialize(
        keys.withColumn("low", F.min("s1").over(same)).withColumn("high", F.max("s1").over(same)).where("low < high").select("key", "s1").distinct()
    )
    some = shared.select("s1").distinct()
    ids = materialize(classes.join(some, "s1", "left_semi").groupBy("s1").agg(F.min("rep").alias("id")))

    def read(some: DataFrame, function, schema: str) -> DataFrame:
        """What ``function`` makes of one text of each class in ``some``; sets are made anew, not kept."""
        texts = pair.join(sendable(some.select("id").distinct()), "id", "left_semi").select("text")
        return texts.mapInArrow(freed(function), schema).join(sendable(some.select("s1")), "s1", "left_semi")

    def sets_of(some: DataFrame) -> DataFrame:
        return read(materialize(ids.join(some, "s1", "left_semi")), _sets, "s1 long, n long, shingles binary")

    points = materialize(read(ids, _points, "s1 long, n long, m0 long, m1 long, point binary"))
    # Blocks of classes that share one of two min-hashes.
    mins = points.select("s1", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("m0").alias("m")), F.struct(F.lit(1).alias("k"), F.col("m1").alias("m")))).alias("h")).select("s1", "h.k", "h.m")
    bucket = sendable(materialize(mins.groupBy("k", "m").agg(F.count("*").alias("many")).where("many > 1")))
    placed = mins.join(bucket, ["k", "m"]).withColumn("block", F.pmod(F.xxhash64("s1", "k"), F.ceil(F.col("many") / BLOCK)).cast("int"))
    blocks = materialize(placed.select("s1", "k", "m", "block"))
    work = sets_of(blocks.select("s1").distinct()).join(sendable(blocks), "s1")
    links = materialize(by_sorted_group(work, ["k", "m", "block"], _join_block, "a long, b long"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b), written in the shared folder, that link."""
        sets = sets_of(pairs.select(F.col("a").alias("s1")).union(pairs.select("b")).distinct())
        left, right = (sets.select(F.col("s1").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
        return materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(freed(_verify), "a long, b long"))

    def joined(now: DataFrame, found: DataFrame) -> DataFrame:
        """``now`` (s1, n, c) with the components united that the links ``found`` connect; only components are linked, not their classes anew."""
        ends = [now.select(F.col("s1").alias(x), F.col("c").alias(f"c{x}")) for x in "ab"]
        between = found.join(ends[0], "a").join(ends[1], "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        united = connected_components(between).select(F.col("node").alias("c"), "component")
        return materialize(now.join(united, "c", "left").select("s1", "n", F.coalesce("component", "c").alias("c")))

    def labels(now: DataFrame) -> DataFrame:
        return now.select(F.col("s1").alias("node"), F.col("c").alias("component"))

    # Shards that hold more than one component. Those of two are a pair; those of a leaf or less are compared as one; the others get a tree.
    now = materialize(_named(connected_components(links), points.select("s1", "n")))
    apart, mixed = _mixed(shared, now)
    two = mixed.where("many = 2").select(F.col("first.s1").alias("a"), F.col("last.s1").alias("b"), F.col("first.n").alias("na"), F.col("last.n").alias("nb"))
    two = two.where("4 * least(na, nb) >= 3 * greatest(na, nb)").select("a", "b")
    few = apart.join(mixed.where(F.col("many").between(3, LEAF)).select("key"), "key").select("key", "s1", "n", "c")
    few = dealt(few, ["key"]).mapInPandas(freed(_near), "a long, b long")
    near = two.union(few).union(_searched(_cells(apart, mixed), points, False)).distinct()
    left, right = (points.select(F.col("s1").alias(x), F.col("point").alias(f"p{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    candidates = materialize(near.join(left, "a").join(right, "b").select("a", "b", "pa", "pb", "na", "nb").mapInArrow(freed(_bounded), "a long, b long"))
    if not candidates.isEmpty() and not (found := verified(candidates)).isEmpty():
        now = joined(now, found)
    # All that is still apart in the larger shards.
    larger = materialize(mixed.where(F.col("many") > LEAF).select("key"))
    if larger.isEmpty():
        return labels(now)
    apart, mixed = _mixed(shared.join(sendable(larger), "key"), now)
    candidates = materialize(_searched(_cells(apart, mixed), points, True).distinct())
    if candidates.isEmpty():
        return labels(now)
    # Of two large components the likeliest pairs are tried first; once joined, the rest need no look.
    order = Window.partitionBy(F.least("ca", "cb"), F.greatest("ca", "cb")).orderBy(F.xxhash64("a", "b"), "a", "b")

    def open_(pairs: DataFrame) -> DataFrame:
        known = [now.select(F.col("s1").alias(x), F.col("c").alias(f"c{x}")) for x in "ab"]
        return pairs.join(known[0], "a").join(known[1], "b").where("ca <> cb")

    tried = materialize(open_(candidates).withColumn("k", F.row_number().over(order)).select("a", "b", "k"))
    if not (found := verified(tried.where(F.col("k") <= TRIES).select("a", "b"))).isEmpty():
        now = joined(now, found)
    rest = tried.where(F.col("k") > TRIES).select("a", "b")
    if not rest.isEmpty() and not (found := verified(materialize(open_(rest).select("a", "b")))).isEmpty():
        now = joined(now, found)
    return labels(now)


def _mixed(shared: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the shards (key, s1, n, c), and of each shard with more than one component its size and two of its rows."""
    apart = shared.join(named, "s1")
    one = F.struct("s1", "n")
    shards = apart.groupBy("key").agg(F.count("*").alias("many"), F.min("c").alias("low"), F.max("c").alias("high"), F.min(one).alias("first"), F.max(one).alias("last"))
    return apart, materialize(shards.where("low < high"))


def _cells(apart: DataFrame, mixed: DataFrame) -> DataFrame:
    """(key, x, y, s1, n, c): the cells in which the members of the larger mixed shards meet.

    A shard of at most CELL members is one cell. A larger one is cut into bands of set sizes, each a third above the one before, and bands into parts
    of about CELL members; parts of the same or of neighbouring bands meet, as sets of others are of too different sizes to link.
    """
    large = apart.join(mixed.where(F.col("many") > LEAF).select("key", "many"), "key")
    whole = large.where(F.col("many") <= CELL).select("key", F.lit("").alias("x"), F.lit("").alias("y"), "s1", "n", "c")
    if mixed.where(F.col("many") > CELL).isEmpty():
        return whole
    # A hundredth more than a third, so that rounding keeps sets that may link in neighbouring bands.
    hot = large.where(F.col("many") > CELL).withColumn("band", F.floor(F.log("n") / F.log(F.lit(4 / 3 + 0.01))).cast("int"))
    bands = materialize(hot.groupBy("key", "band").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts")))
    slots = bands.select("key", F.col("band").alias("other_band"), F.explode(F.expr("sequence(0, parts - 1)")).alias("other_part"))
    own = hot.join(bands, ["key", "band"]).withColumn("part", F.pmod(F.xxhash64("s1"), F.col("parts")).cast("int"))
    met = own.join(slots, "key").where("abs(band - other_band) <= 1")
    a, b = F.format_string("%06d:%06d", "band", "part"), F.format_string("%06d:%06d", "other_band", "other_part")
    return whole.union(met.select("key", F.least(a, b).alias("x"), F.greatest(a, b).alias("y"), "s1", "n", "c"))


def _searched(cells: DataFrame, points: DataFrame, all_pairs: bool) -> DataFrame:
    """Pairs (a, b) that the trees of the cells leave."""
    full = cells.join(points.select("s1", "point"), "s1")
    return dealt(full, ["key", "x", "y"]).mapInPandas(freed(_candidates(all_pairs)), "a long, b long")

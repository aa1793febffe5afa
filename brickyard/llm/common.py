"""What the operators of this subpackage share: tables, shared scratch space and partition helpers."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``; only Spark's own reader touches the path, which may be in any store."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent in local mode (tests) a temporary folder is set and used; on a
    cluster its absence raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="brickyard-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/brickyard/{uuid.uuid4().hex}"


#: Bytes of an Arrow batch that a Python task gets at most (a longer row is a batch of its own).
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of Python tasks by bytes, as rows here may be long texts or packed blocks.

    Plans read the session's setting when they run, so it stays as it is set here.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory to the system; workers are kept for later tasks, and so would be what they once used."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        gc.collect()


def freed(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` over the batches of a task, giving memory back now and then and at its end."""

    def inner(batches: Iterator) -> Iterator:
        for k, out in enumerate(work(batches)):
            yield out
            if k % 16 == 15:
                give_back()
        give_back()

    return inner


#: Frames written inside each open ``scratch``, innermost last.
_WRITTEN: list[list[DataFrame]] = []


def materialize(df: DataFrame, keep: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    Unlike localCheckpoint the files outlive any executor, and later scans prune columns. Inside ``scratch`` the files go
    when it ends, but for those of frames to ``keep``.
    """
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if _WRITTEN and not keep:
        _WRITTEN[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[None]:
    """Delete what is materialized inside, once nothing inside can read it again."""
    _WRITTEN.append([])
    try:
        yield
    finally:
        for df in _WRITTEN.pop():
            drop(df)


def drop(df: DataFrame) -> None:
    """Delete the files behind a materialized frame that nothing will read again."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for parent in {os.path.dirname(f) for f in df.inputFiles() if "/brickyard/" in f}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


#: Rows of a few numbers that are sent to all tasks to pick others by, at most; more are joined by a shuffle.
SEND_IDS = 1_000_000


def sendable(ids: DataFrame) -> DataFrame:
    """``ids``, a few columns of numbers in the shared folder, marked for broadcast if its counted size allows."""
    return F.broadcast(ids) if ids.count() <= SEND_IDS else ids


def discard(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose id and text hash (null ids equal each other) are in ``rows`` (id_col, text_hash).

    Other texts of the same id stay.
    """
    bad = sendable(materialize(rows.select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash")).distinct()))
    same = docs[id_col].eqNullSafe(bad["__id"]) & (F.xxhash64(docs[text_col]) == bad["__hash"])
    return docs.join(bad, same, "left_anti").select(docs.columns)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, the knob that scales every keyed stage here."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(column: str, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that what is made of a batch stays small."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.slice(k, rows)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.large_binary()).to_pylist()


def ascii_words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of anything but ASCII white space."""
    return (text or b"").lower().split()


#: ASCII letters and digits and all bytes of 0x80 and above stay, A-Z fall, the rest become spaces.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def plain_words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of letters, digits and non-ASCII characters."""
    return (text or b"").translate(_PLAIN).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (the splitmix finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _weight(frame: pd.DataFrame) -> int:
    """About how many bytes a frame holds; only columns of bytes and arrays are measured, others count 16 a cell."""
    out = 16 * frame.size
    for c in frame.columns:
        if frame[c].dtype == object:
            out += sum(len(x) if isinstance(x, (bytes, bytearray)) else x.nbytes for x in frame[c] if isinstance(x, (bytes, bytearray, np.ndarray)))
    return out


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str], room: int = 16 << 20) -> Iterator[pd.DataFrame]:
    """Cut a partition sorted by ``keys`` into frames of whole groups, of about ``room`` bytes at least.

    A group is never split between two frames; memory is bounded by ``room``, a batch and the largest group.
    """
    held: list[pd.DataFrame] = []
    n = 0
    for frame in frames:
        if frame.empty:
            continue
        held.append(frame)
        n += _weight(frame)
        if n < room:
            continue
        whole = pd.concat(held, ignore_index=True)
        same = np.ones(len(whole), bool)
        for k in keys:
            same &= (whole[k] == whole[k].iloc[-1]).to_numpy()
        cut = int(np.argmax(same))
        if cut:
            yield whole.iloc[:cut]
            whole = whole.iloc[cut:]
        held, n = [whole], _weight(whole)
    if held:
        yield pd.concat(held, ignore_index=True)


def cuts(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where the groups of a frame sorted by ``keys`` start, and its end."""
    change = np.zeros(len(frame), bool)
    for k in keys:
        v = frame[k].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.concatenate([[0], np.flatnonzero(change), [len(frame)]])


def dealt(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """``df`` with the rows of equal ``keys`` in one partition, sorted by ``keys`` or ``order``.

    Rows are dealt by a hash of the keys: a repartition by the keys themselves is taken out where a join below has
    dealt them so already, and adaptive execution may then split that join's partitions.
    """
    return df.repartition(partitions(df.sparkSession), F.xxhash64(*keys)).sortWithinPartitions(*(order or keys))


def by_sorted_group(df: DataFrame, keys: list[str], function: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """Apply ``function`` to each group of ``keys``, many small groups to a batch.

    One shuffle by the keys and a sort; unlike applyInPandas there is no cost per group
    beyond the function itself, so millions of groups of two are fine.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in whole_groups(frames, keys):
            at = cuts(some, keys).tolist()
            out = [x for a, b in zip(at, at[1:]) if (x := function(some.iloc[a:b])) is not None and len(x)]
            if out:
                yield pd.concat(out, ignore_index=True)

    return dealt(df, keys).mapInPandas(freed(work), schema)


class Forest:
    """Union-find over small integers; the root of a tree is its smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

"""Rows that are worked on once: which are done is state of the stream, and what came of them is added once.

The keys that are done are kept by the state store, part by part beside the tasks, so no batch reads the
table. The state store and the table agree after any stop: a batch that is played again gives the same
rows, and the table knows the last batch it took.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from brickyard.operators.keyed import blank
from brickyard.sources import versions

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Once(StatefulProcessor):
    """Lets the first row of a key through, by ``order`` within a batch, and remembers the key."""

    def __init__(self, order: list[str], columns: list[str]):
        self.order, self.columns = order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            return
        first = None
        for frame in rows:
            # One row is kept of what came so far, so a hot key holds no memory.
            best = frame if first is None else pd.concat([first, frame])
            first = best.sort_values(self.order, kind="stable").iloc[:1]
        if first is not None and len(first):
            self.done.update((True,))
            yield first[self.columns]

    def handleInitialState(self, key, state: pd.DataFrame, timer) -> None:
        if not self.done.exists():
            self.done.update((True,))

    def close(self) -> None:
        pass


def once_per_key(stream: DataFrame, key: str, order: list[str], done: DataFrame | None = None) -> DataFrame:
    """The first row of each key over the whole life of the stream; keys of ``done`` (a table with that column) count as seen.

    Blank keys are left out. ``done`` is read when the stream first starts, never again. Keys are remembered without end, by
    RocksDB on the executors' disks. A hot key goes to one task, which keeps one row of it.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    some = stream.where(~blank(F.col(key)))
    known = None if done is None else done.where(~blank(F.col(key))).select(key).distinct().groupBy(key)
    return some.groupBy(key).transformWithStateInPandas(_Once(order, stream.columns), stream.schema, "Append", "None", initialState=known)


def append_once(stream: DataFrame, path: str, key: str, order: list[str], checkpoint: str, work: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Add to the versioned table in ``path`` the first row of each key that it lacks, after ``work``; starts and returns the query.

    Stopped at any moment and started again with its checkpoint it repeats no row and loses none: a batch counts as taken
    when the table's manifest names it.
    """
    spark = stream.sparkSession
    done = None
    if (now := versions.current(spark, path)) is not None and now["folders"]:
        # Keys that this stream has added are in its state already; marking them again changes nothing.
        done = versions.read(spark, path)
    new = once_per_key(stream, key, order, done)

    def add(batch: DataFrame, number: int) -> None:
        if versions.append(work(batch) if work else batch, path, checkpoint, number) is None:
            # The table has this batch from before a stop; only the state has still to take it.
            batch.write.format("noop").mode("overwrite").save()

    return new.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()

"""Tables that are replaced or extended at once: folders of data, and numbered manifests that name them.

``path/data/...`` holds folders that are written once. ``path/manifests/000000000007.json`` says which of them are
version 7. A manifest is written beside its place and then moved there, without overwriting: a reader
sees the version before or the one after, and of two writers that began with the same version one fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer has made the next version meanwhile."""


class _Files:
    """A folder in any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self._p("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self._p(folder))) if self.fs.exists(self._p(folder)) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._p(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Whether ``name`` was not there and now is, whole."""
        beside = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self._p(beside), False)
        stream.write(text.encode())
        stream.close()
        # A move onto what is there is refused by the store; some local ones would replace it, so it is looked at first.
        done = not self.fs.exists(self._p(name)) and self.fs.rename(self._p(beside), self._p(name))
        if not done:
            self.fs.delete(self._p(beside), False)
        return done

    def delete(self, name: str) -> None:
        self.fs.delete(self._p(name), True)


def _manifest(n: int) -> str:
    return f"manifests/{n:012d}.json"


def current(spark: SparkSession, path: str) -> dict | None:
    """The newest manifest: version, folders, schema, format, and the last batch of each stream; None without a table."""
    files = _Files(spark, path)
    found = [x for x in files.names("manifests") if x.endswith(".json")]
    return json.loads(files.read(f"manifests/{found[-1]}")) if found else None


def read(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """The newest version, as it was when this was called; a table that is not there is empty, with ``schema``."""
    now = current(spark, path)
    if now is None:
        return spark.createDataFrame([], schema or "value string")
    own = T.StructType.fromJson(now["schema"])
    if not now["folders"]:
        return spark.createDataFrame([], own)
    reader = spark.read.schema(own).format(now["format"])
    reader = reader.options(header=True, multiLine=True, quote='"', escape='"') if now["format"] == "csv" else reader
    rows = reader.load([f"{path.rstrip('/')}/{f}" for f in now["folders"]])
    return rows.na.fill("") if now["format"] == "csv" else rows


def _add(rows: DataFrame, path: str, old: dict | None, keep: list[str], kind: str, batches: dict[str, int]) -> int:
    spark = rows.sparkSession
    files = _Files(spark, path)
    folder = f"data/{uuid.uuid4().hex}"
    writer = rows.write.format(kind)
    writer = writer.options(header=True, quote='"', escape='"') if kind == "csv" else writer
    try:
        writer.save(f"{path.rstrip('/')}/{folder}")
        n = (old["version"] if old else 0) + 1
        made = {"version": n, "folders": [*keep, folder], "format": kind, "schema": rows.schema.jsonValue(), "batches": batches}
        if not files.put_new(_manifest(n), json.dumps(made)):
            raise Conflict(f"version {n} of {path} is there already")
    except Exception:
        files.delete(folder)
        raise
    return n


def replace(rows: DataFrame, path: str, kind: str = "parquet") -> int:
    """Make ``rows`` the next version, which is returned; they may come from the version before. A failure leaves that as it is."""
    old = current(rows.sparkSession, path)
    return _add(rows, path, old, [], kind, old["batches"] if old else {})


def append(rows: DataFrame, path: str, stream: str | None = None, batch: int = 0) -> int | None:
    """Add ``rows`` as a folder of the next version, which is returned.

    A batch of a stream that the table has already, as after a restart, adds nothing and returns None. Columns are those of
    the table, by name.
    """
    old = current(rows.sparkSession, path)
    batches = dict(old["batches"]) if old else {}
    if stream is not None:
        if batches.get(stream, -1) >= batch:
            return None
        batches[stream] = batch
    if old:
        rows = rows.select(*(F.col(f"`{f['name']}`") for f in old["schema"]["fields"]))
    return _add(rows, path, old, old["folders"] if old else [], old["format"] if old else "parquet", batches)


def vacuum(spark: SparkSession, path: str, versions: int = 2) -> None:
    """Delete what only versions before the newest ``versions`` need. Readers of those, and writers under way, must be done."""
    files = _Files(spark, path)
    listed = [x for x in files.names("manifests") if x.endswith(".json")]
    stay = listed[-max(versions, 1) :]
    used = {f for x in stay for f in json.loads(files.read(f"manifests/{x}"))["folders"]}
    for x in listed:
        if x not in stay:
            files.delete(f"manifests/{x}")
    for x in files.names("data"):
        if f"data/{x}" not in used:
            files.delete(f"data/{x}")


def upsert(new: DataFrame, path: str, key: str, order: list[str] | None = None) -> int:
    """The next version: rows of ``new`` in place of those that have their key, the others kept, sorted by key.

    Of new rows that share a key the first by ``order`` (all columns, where none is given) counts; null keys are left out. Sorting
    is by ranges, so files follow each other.
    """
    from brickyard.operators.keyed import first_of_key

    some = first_of_key(new.where(F.col(key).isNotNull()), key, order or [c for c in new.columns if c != key])
    old = read(new.sparkSession, path, new.schema)
    every = old.join(some.select(key), key, "left_anti").select(new.columns).union(some.select(new.columns))
    return replace(every.orderBy(key), path)

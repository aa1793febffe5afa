"""WARC archives: writing records with deduplicated payloads, and reading by boundary chains.

A record is known by its place, not by its first bytes: a payload may hold text that looks like
a record. The reader cuts an archive at each magic string, whatever it belongs to, so any task can
read any part of a file. Each piece that parses as a header names its own place and the place
where the next record would start. Pointer jumping from the start of each file then keeps the
places that are reached; the rest is payload, and goes back to the record it was cut from.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, freed, materialize, shared_dir, small_batches

#: Payloads of fewer bytes are never written as revisits.
LEAST_REVISIT = 100
#: Payloads that occur more than once, and splits of archives, that are sent to all tasks, at most.
SEND_PAYLOADS, SEND_SPLITS = 200_000, 200_000
_MAGIC = "WARC/1.1\r\n"
_END = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def digest(text: Column) -> Column:
    """SHA-256 of a text's UTF-8 bytes; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def plan_records(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, payload_digest, payload_bytes, refers_to`` for each page.

    The smallest page_id of each payload of at least LEAST_REVISIT bytes is the response that
    the others refer to. The smallest ids are taken map side first, so a payload that a third of
    all pages share reaches its group as one row from each task. Payloads that occur twice or more
    are sent to all tasks while they are at most SEND_PAYLOADS (about 100 bytes each), so no page
    is shuffled; more of them are joined by a shuffle, which splits a hot payload's pages. Rows that repeat the smallest
    page_id are all responses; a null page_id never answers for others.
    """
    html = F.coalesce("html", F.lit(""))
    some = pages.select("page_id", "url", html.alias("html"), digest(F.col("html")).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    first = some.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = materialize(first)
    return some.join(F.broadcast(first) if first.count() <= SEND_PAYLOADS else first, "payload_digest", "left").select(
        "page_id", "url", "html", "payload_digest", "payload_bytes", F.expr("if(page_id <> first, first, null)").alias("refers_to")
    )


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def write(pages: DataFrame, path: str, date: str | None = None) -> None:
    """Write a record for each page as uncompressed archives in the folder ``path``, dated ``date`` (UTC, now if not given).

    Spark's text writer ends each record with the two line ends of the format, so the archives can
    be in any store it writes to. Line ends in a url are dropped from its header.
    """
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    p = plan_records(pages)
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(_HTTP), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    header = F.concat_ws(
        "\r\n",
        F.lit(_MAGIC[:-2]),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\r\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("refers_to")))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
    )
    p.withColumn("block", block).select(F.concat(header, F.lit("\r\n\r\n"), F.col("block")).alias("value")).write.option("lineSep", _END).text(path)


_LENGTH = re.compile(rb"(?:^|\r\n)Content-Length: *([0-9]{1,18})\r\n", re.I)


def _step(value: bytes) -> int | None:
    """From the magic before a piece to the magic of the next record, if the piece parses as a header."""
    head = value.find(b"\r\n\r\n")
    m = _LENGTH.search(value, 0, head + 2) if head >= 0 else None
    return len(_MAGIC) + head + 4 + int(m[1]) + len(_END) if m else None


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place of each piece within its split, its length, and how far the next record is if it is a header."""
    split, at = None, 0
    for batch in batches:
        offsets, sizes, steps = [], [], []
        values = batch.column(0).cast(pa.large_binary()).to_pylist()
        for value, file, start in zip(values, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if (file, start) != split:
                split, at = (file, start), 0
            offsets.append(at)
            sizes.append(len(value))
            steps.append(_step(value))
            at += len(value) + len(_MAGIC)
        yield pa.record_batch(
            [batch.column(1), batch.column(2), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64()), pa.array(steps, pa.int64())],
            ["file", "start", "at", "size", "step"],
        )


def _reach(candidates: DataFrame, starts: DataFrame) -> DataFrame:
    """(file, place) of the candidates (file, place, next) reached from ``starts`` by pointer jumping.

    After round k the pointers leap 2^k records and all records within 2^k of a start are known,
    so a file of n records takes log2(n) rounds; each is written to the shared folder.
    """
    # Written columns of paths and places look tiny to the planner, so it is told not to broadcast them.
    places = candidates.select("file", "place").hint("merge")
    reached = materialize(starts.join(places, ["file", "place"], "left_semi"))
    leap = materialize(candidates)
    count = reached.count()
    while True:
        far = reached.join(leap.hint("merge"), ["file", "place"]).select("file", F.col("next").alias("place"))
        more = materialize(reached.union(far.join(places, ["file", "place"], "left_semi")).distinct())
        n = more.count()
        drop(reached)
        reached = more
        if n == count:
            break
        count = n
        to = leap.select("file", F.col("place").alias("next"), F.col("next").alias("after"))
        longer = materialize(leap.join(to.hint("merge"), ["file", "next"]).select("file", "place", F.col("after").alias("next")))
        drop(leap)
        leap = longer
    drop(leap)
    return reached


def read(spark: SparkSession, path: str) -> DataFrame:
    """``file, place, header, http, payload`` (binary) of each record of the archives in a folder.

    Text before the first record of a file and after the end of the chain is left out. A file
    whose first bytes are no record gives none; empty files give none.
    """
    small_batches(spark)
    raw = spark.read.option("lineSep", _MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    small = materialize(raw.mapInArrow(freed(_pieces), "file string, start long, at long, size long, step long"))
    # A split's first piece lies where the pieces of the splits before it end. Splits are few.
    total = small.groupBy("file", "start").agg(F.sum(F.col("size") + len(_MAGIC)).alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    base = total.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    placed = materialize(small.join(base.hint("merge"), ["file", "start"]).withColumn("place", F.col("base") + F.col("at") - len(_MAGIC)))
    drop(small)
    candidates = placed.where(F.col("step").isNotNull() & (F.col("place") >= 0)).select("file", "place", (F.col("place") + F.col("step")).alias("next"))
    starts = placed.select("file", F.lit(0).cast("long").alias("place")).distinct()
    true = _reach(candidates, starts).withColumn("true", F.lit(True))
    # The first true record of each split is all that the tasks need to follow the chain through it.
    entry = F.min(F.when(F.col("true"), F.col("place"))).alias("entry")
    entries = materialize(placed.hint("merge").join(true.hint("merge"), ["file", "place"], "left").groupBy("file", "start").agg(F.first("base").alias("base"), entry))
    if entries.count() <= SEND_SPLITS:
        known = raw.join(F.broadcast(entries), ["file", "start"])
    else:  # a shuffle loses the order of the pieces, which their numbers bring back
        known = raw.withColumn("seq", F.monotonically_increasing_id()).join(entries, ["file", "start"]).sortWithinPartitions("file", "start", "seq")
    followed = known.select("value", "file", "start", "base", "entry").mapInArrow(freed(_follow), "file string, place long, step long, whole binary, kind int")
    # Records that go on in the next split are few, and are put together from their pieces.
    rest = followed.where("kind > 0").withColumn("record", F.last(F.when(F.col("kind") == 1, F.col("place")), True).over(Window.partitionBy("file").orderBy("place")))
    parts = rest.where("record is not null").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("place", "whole"))).alias("parts"), F.max("step").alias("step"))
    joined = F.aggregate(
        F.slice("parts", F.lit(2), F.size("parts")), F.element_at("parts", 1)["whole"], lambda x, y: F.concat(x, F.lit(_MAGIC).cast("binary"), y["whole"])
    )
    whole = followed.where("kind = 0").select("file", "place", "whole", "step").union(parts.select("file", F.col("record").alias("place"), joined.alias("whole"), "step"))
    return whole.mapInArrow(freed(_open), "file string, place long, header string, http string, payload binary")


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each split from its first true one on: whole (kind 0), or what there is of one that
    goes on in the next split (1), and the pieces before the first (2)."""
    split, at, held = None, 0, None
    due: int | None = None
    for batch in batches:
        out: list[tuple] = []
        for value, file, start, base, entry in zip(batch.column(0).cast(pa.large_binary()).to_pylist(), *(c.to_pylist() for c in batch.columns[1:])):
            if (file, start) != split:
                if held:
                    out.append((*held[:3], b"".join(held[3]), 1))
                split, at, held, due = (file, start), 0, None, entry
            place = base + at - len(_MAGIC)
            at += len(value) + len(_MAGIC)
            if held:
                held[3].append(_MAGIC.encode() + value)
            elif place == due and (step := _step(value)) is not None:
                held = [file, place, step, [value]]
            elif place >= 0 and (entry is None or place < entry):
                out.append((file, place, None, value, 2))
            if held and base + at - held[1] - len(_MAGIC) >= held[2]:
                out.append((*held[:3], b"".join(held[3]), 0))
                due, held = held[1] + held[2], None
        yield _rows(out)
    yield _rows([(*held[:3], b"".join(held[3]), 1)] if held else [])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = [*zip(*rows)] if rows else [()] * 5
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int32()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "place", "step", "whole", "kind"])


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut whole records into WARC header, HTTP header and payload."""
    for batch in batches:
        headers, https, payloads = [], [], []
        for whole, step in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            head = whole.find(b"\r\n\r\n")
            block = whole[head + 4 : step - len(_MAGIC) - len(_END)]
            http = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -1
            headers.append(whole[: head + 2].decode("utf-8", "replace"))
            https.append(block[: http + 2].decode("utf-8", "replace") if http >= 0 else None)
            payloads.append(block[http + 4 :] if http >= 0 else block)
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(headers, pa.string()), pa.array(https, pa.string()), pa.array(payloads, pa.binary())],
            ["file", "place", "header", "http", "payload"],
        )


def field(header: Column, name: str) -> Column:
    """A header field's value; null where it is missing."""
    value = F.regexp_extract(header, rf"(?i)(?:^|\r\n){name}: *([^\r\n]*)", 1)
    return F.when(value != "", value)


def summary(records: DataFrame) -> DataFrame:
    """Page, payload and kind of each record read; a revisit's payload is known by its own fields."""
    header = F.col("header")
    http = F.coalesce("http", F.lit(""))
    page = F.regexp_extract(F.coalesce(field(header, "WARC-Record-ID"), F.lit("")), "<urn:page:(-?[0-9]+)>", 1)
    refers = F.regexp_extract(F.coalesce(field(header, "WARC-Refers-To"), F.lit("")), "<urn:page:(-?[0-9]+)>", 1)
    kind = field(header, "WARC-Type")
    revisit = kind == "revisit"
    return records.select(
        F.when(page != "", page).cast("long").alias("page_id"),
        F.when(revisit, field(http, "Content-Length").cast("long")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.substring(field(header, "WARC-Payload-Digest"), 8, 64)).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        kind.alias("record_type"), F.when(refers != "", refers).cast("long").alias("refers_to"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives in the shared folder, read them back and sum up each record."""
    path = shared_dir(pages.sparkSession)
    write(pages, path)
    return summary(read(pages.sparkSession, path))

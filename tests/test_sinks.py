"""Pages over HTTP, spreadsheets, versioned tables and work done once, against servers and kills of the test."""

import json
import re
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from brickyard.sources import html, pages, sheets, versions
from brickyard.streaming import checkpoints


def served(handler):
    server = ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server, f"http://127.0.0.1:{server.server_port}"


@pytest.fixture
def site():
    """Pages by path: /ok, one that answers at the third try, one that is refused, one in another alphabet."""
    asked = Counter()

    class Site(BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.path] += 1
            path = self.path.split("?")[0]
            status = 200 if path.startswith("/ok") or path == "/cp" or path == "/late" and asked[self.path] == 3 else 404 if path == "/gone" else 503
            body = f"<p>{self.path} №{asked[self.path]}</p>".encode("cp1251" if path == "/cp" else "utf-8")
            self.send_response(status)
            self.send_header("Content-Type", "text/html" + ("; charset=windows-1251" if path == "/cp" else ""))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server, root = served(Site)
    yield root, asked
    server.shutdown()


def listed(spark, root, paths):
    return spark.createDataFrame([(k, f"s{k}", "c", root + p, root) for k, p in enumerate(paths)], "pos int, source string, city string, url string, base_url string")


def test_pages_are_rows_with_errors(spark, site):
    root, asked = site
    got = pages.scan_pages(spark, 2, listed(spark, root, ["/ok", "/late", "/gone", "/down", "/cp"]), tries=3)
    assert got.rdd.getNumPartitions() == 10
    rows = {(r.source, r.page): r for r in got.collect()}
    assert [rows[k].ord for k in sorted(rows)] == list(range(10))
    ok = rows["s0", 2]
    assert (ok.status, ok.attempts, ok.error, ok.html, ok.url) == (200, 1, None, "<p>/ok?page=2 №1</p>", root + "/ok?page=2")
    assert (rows["s1", 1].status, rows["s1", 1].attempts) == (200, 3) and rows["s4", 1].html == "<p>/cp №1</p>"
    assert (rows["s2", 1].status, rows["s2", 1].attempts, rows["s2", 1].error, rows["s2", 1].html) == (404, 1, "HTTP 404", None)
    assert (rows["s3", 1].status, rows["s3", 1].attempts, asked["/down"]) == (503, 3, 3)


def test_filters_and_columns_reach_the_scan(spark, site):
    root, asked = site
    some = pages.scan_pages(spark, 3, listed(spark, root, ["/ok1", "/ok2"]))
    assert [r.page for r in some.where("source = 's1' and page in (2, 3) and length(html) > 0").orderBy("page").collect()] == [2, 3]
    assert set(asked) == {"/ok2?page=2", "/ok2?page=3"}
    asked.clear()
    assert pages.scan_pages(spark, 2, listed(spark, root, ["/ok1"]), "page int, url string").count() == 2 and not asked
    assert [tuple(r) for r in pages.scan_pages(spark, 1, listed(spark, root, ["/gone"]), "status int, source string").collect()] == [(404, "s0")]
    with pytest.raises(Exception, match="no"):
        pages.scan_pages(spark, 1, listed(spark, root, ["/ok"]), "other string").collect()
    assert pages.scan_pages(spark, 1, listed(spark, root, [])).count() == 0


def test_urls_of_a_table_are_fetched(spark, site):
    root, _ = site
    rows = spark.createDataFrame([(1, root + "/ok"), (2, None), (3, root + "/gone"), (4, "http://127.0.0.1:1/x"), (5, "no url at all")], "k int, u string").repartition(2)
    got = {r.k: r for r in pages.fetched(rows, "u", tries=1).collect()}
    assert got[1].html.startswith("<p>/ok") and (got[2].error, got[2].attempts) == ("no url", 0) and got[3].status == 404
    assert got[4].status is None and got[4].error and got[5].error.startswith("ValueError")


def test_extractors_join_laterally(spark):
    names = html.register_extractors(spark)
    assert names["DIM.RIA"] == "cards_dim_ria" and set(names) == set(html.CARDS)
    page = '<div data-cy="l-card"><a href="/d/1">A</a></div><div data-cy="l-card"><a href="/d/2">B</a></div>'
    spark.createDataFrame([(1, "OLX", page), (2, "OLX", None), (3, "REM.ua", page), (4, None, page)], "id int, source string, html string").createOrReplaceTempView("landed_pages")
    one = spark.sql("SELECT id, c.pos, c.href FROM landed_pages p, LATERAL cards_olx(p.html) c WHERE p.source = 'OLX'")
    every = spark.sql("SELECT id, c.pos, c.href FROM landed_pages p, LATERAL cards(p.source, p.html) c")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, every.collect())) == [(1, 0, "/d/1"), (1, 1, "/d/2")]


# Spreadsheets -------------------------------------------------------------------------------------------------------


class Book:
    """A spreadsheet service in memory: the calls that the writer makes, batches all or nothing."""

    def __init__(self, tabs):
        self.tabs = {k: {"title": t, "cells": [list(r) for r in c], "look": set()} for k, (t, c) in enumerate(tabs.items())}
        self.refuse = lambda request: False
        self.calls = []

    def cells(self, title):
        return next((t["cells"] for t in self.tabs.values() if t["title"] == title), None)

    def apply(self, requests):
        tabs = json.loads(json.dumps({str(k): v | {"look": sorted(v["look"])} for k, v in self.tabs.items()}))
        for r in requests:
            (name, q), = r.items()
            if self.refuse(name):
                return False
            if name == "addSheet":
                p = q["properties"]
                assert str(p["sheetId"]) not in tabs and all(t["title"] != p["title"] for t in tabs.values())
                tabs[str(p["sheetId"])] = {"title": p["title"], "cells": [], "look": []}
            elif name == "deleteSheet":
                del tabs[str(q["sheetId"])]
            elif name == "updateCells":
                tabs[str(q["range"]["sheetId"])]["cells"].insert(0, [v["userEnteredValue"]["stringValue"] for v in q["rows"][0]["values"]])
            elif name == "copyPaste":
                a, b = q["source"], q["destination"]
                to = tabs[str(b["sheetId"])]["cells"]
                assert len(to) == b["startRowIndex"] and b["endRowIndex"] - b["startRowIndex"] == a["endRowIndex"] - a["startRowIndex"]
                to += tabs[str(a["sheetId"])]["cells"][a["startRowIndex"] : a["endRowIndex"]]
            elif name == "updateSheetProperties":
                assert all(t["title"] != q["properties"]["title"] for t in tabs.values())
                tabs[str(q["properties"]["sheetId"])]["title"] = q["properties"]["title"]
            else:
                tabs[str(json.loads(re.search(r'"sheetId": (\d+)', json.dumps(q))[1]))]["look"].append(name)
        self.tabs = {int(k): v | {"look": set(v["look"])} for k, v in tabs.items()}
        return True


@pytest.fixture
def book():
    service = Book({"Other": [["x"]], "Flats": [["old", "grid"], ["1", "2"]]})
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def answer(self, body, status=200):
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):
            with lock:
                self.answer({"sheets": [{"properties": {"title": t["title"], "sheetId": k}} for k, t in service.tabs.items()]})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            with lock:
                service.calls.append(self.path)
                if self.path.endswith(":batchUpdate"):
                    return self.answer({}, 200 if service.apply(body["requests"]) else 400)
                title = re.search(r"/values/(.+)!A1:append", self.path)[1]
                service.cells(title).extend(body["values"])
                self.answer({})

        def log_message(self, *_):
            pass

    server, root = served(Handler)
    yield service, root
    server.shutdown()


def test_a_tab_is_replaced_at_once(spark, book):
    service, root = book
    rows = spark.range(0, 5_000, 1, 4).selectExpr("id", "if(id % 2 = 0, null, concat('r', id)) AS `назва`")
    sheets.write_sheet(rows, "https://docs.example/spreadsheets/d/abc-1/edit", "Flats", "token", root)
    want = [["id", "назва"]] + [[str(k), "" if k % 2 == 0 else f"r{k}"] for k in range(5_000)]
    assert service.cells("Flats") == want and {t["title"] for t in service.tabs.values()} == {"Other", "Flats"}
    look = next(t["look"] for t in service.tabs.values() if t["title"] == "Flats")
    assert look == {"repeatCell", "setBasicFilter", "autoResizeDimensions"} and "/v4/spreadsheets/abc-1:batchUpdate" in service.calls
    sheets.write_sheet(rows.limit(0), "abc-1", "New", None, root)
    assert service.cells("New") == [["id", "назва"]] and service.cells("Flats") == want


def test_a_failing_task_leaves_the_old_grid(spark, book):
    service, root = book
    shown = lambda: json.dumps(sorted((t["title"], t["cells"]) for t in service.tabs.values() if not t["title"].startswith(".")))
    before = shown()
    bad = spark.range(0, 4_000, 1, 4).select(F.when(F.col("id") < 3_900, F.col("id")).otherwise(F.raise_error(F.lit("broken task")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="broken task|Writing job|abort"):
        sheets.write_sheet(bad, "abc", "Flats", None, root)
    assert shown() == before
    # A commit that the service refuses changes nothing either.
    service.refuse = lambda name: name == "setBasicFilter"
    with pytest.raises(Exception):
        sheets.write_sheet(spark.range(10), "abc", "Flats", None, root)
    assert service.cells("Flats") == [["old", "grid"], ["1", "2"]]
    # What a task that outlived its job left goes with the next write.
    service.refuse = lambda name: False
    service.tabs[99] = {"title": ".Flats.0123.0.0", "cells": [["late"]], "look": set()}
    sheets.write_sheet(spark.range(2), "abc", "Flats", None, root)
    assert service.cells("Flats") == [["id"], ["0"], ["1"]] and {t["title"] for t in service.tabs.values()} == {"Flats", "Other"}
    with pytest.raises(Exception, match="overwrite"):
        spark.range(1).write.format("sheet").options(sheet="abc", tab="Flats", endpoint=root).mode("append").save()


# Versioned tables ---------------------------------------------------------------------------------------------------


def test_readers_see_one_version_or_the_other(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.read(spark, path, "k long, v long").collect() == [] and versions.current(spark, path) is None
    assert versions.replace(spark.range(0, 1_000, 1, 4).selectExpr("id AS k", "1L AS v"), path) == 1
    seen, stop = [], threading.Event()

    def look():
        while not stop.is_set():
            seen.append(tuple(versions.read(spark, path).selectExpr("count(*)", "min(v)", "max(v)").first()))

    reader = threading.Thread(target=look)
    reader.start()
    for v in range(2, 7):
        # The next version is made of the one before.
        assert versions.replace(versions.read(spark, path).selectExpr("k", "v + 1 AS v"), path) == v
    stop.set()
    reader.join()
    assert seen and all(n == 1_000 and a == b for n, a, b in seen) and versions.read(spark, path).where("v = 6").count() == 1_000


def test_failures_and_conflicts_leave_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versions.replace(spark.range(5), path)
    with pytest.raises(Exception, match="broken"):
        versions.replace(spark.range(0, 100, 1, 4).select(F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("broken")).cast("long")).alias("id")), path)
    assert versions.read(spark, path).count() == 5 and len(list((tmp_path / "t" / "data").iterdir())) == 1
    # Two writers that began with version 1: the second to finish fails.
    old = versions.current(spark, path)
    assert versions.append(spark.range(5, 8), path) == 2
    monkeypatch.setattr(versions, "current", lambda *_: old)
    with pytest.raises(versions.Conflict):
        versions.replace(spark.range(1), path)
    monkeypatch.undo()
    assert sorted(r.id for r in versions.read(spark, path).collect()) == list(range(8))
    versions.replace(spark.range(2), path)
    versions.vacuum(spark, path, 1)
    assert versions.read(spark, path).count() == 2 and len(list((tmp_path / "t" / "data").iterdir())) == 1


def test_csv_versions_and_cache_upserts(spark, tmp_path):
    rows = spark.createDataFrame([('a "q", b\nline', "", "№1"), ("", "x", "é")], "`опис` string, b string, c string")
    versions.replace(rows, str(tmp_path / "csv"), "csv")
    assert sorted(map(tuple, versions.read(spark, str(tmp_path / "csv")).collect())) == sorted(map(tuple, rows.collect()))
    path, shape = str(tmp_path / "cache"), "query string, lat double, lon double"
    versions.upsert(spark.createDataFrame([("b", 1.0, 2.0), ("a", None, None), (None, 1.0, 1.0)], shape), path, "query")
    versions.upsert(spark.createDataFrame([("a", 5.0, 6.0), ("c", None, None), ("c", None, None)], shape), path, "query")
    assert [tuple(r) for r in versions.read(spark, path).collect()] == [("a", 5.0, 6.0), ("b", 1.0, 2.0), ("c", None, None)]


# Work done once -----------------------------------------------------------------------------------------------------


def test_rows_are_done_once_over_kills_and_restarts(spark, tmp_path):
    shape, path, check = "url string, v int", str(tmp_path / "out"), str(tmp_path / "check")

    def land(rows):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    versions.replace(spark.createDataFrame([("known", 0)], shape), path)
    land([("a", 2), ("a", 1), ("b", 1), ("known", 9), ("", 1), (None, 1)])
    fail = [None]

    def work(batch):
        if fail[0] == "before":
            raise RuntimeError("killed before the table took the batch")
        return batch.withColumn("v", F.col("v") * 10)

    def run(expect=None):
        stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
        q = checkpoints.append_once(stream, path, "url", ["v"], check, work)
        try:
            if expect:
                with pytest.raises(Exception, match=expect):
                    q.processAllAvailable()
            else:
                q.processAllAvailable()
        finally:
            q.stop()

    def table():
        return sorted(map(tuple, versions.read(spark, path).collect()))

    run()
    assert table() == [("a", 10), ("b", 10), ("known", 0)]
    land([("b", 5), ("c", 1), ("c", 3)])
    fail[0] = "before"
    run("killed before")
    assert table() == [("a", 10), ("b", 10), ("known", 0)]
    fail[0] = None
    # Killed after the table took the batch, before the stream knew: the batch is played again and adds nothing.
    append = versions.append

    def cut(*args):
        append(*args)
        raise RuntimeError("killed after the table took the batch")

    versions.append = cut
    try:
        run("killed after")
    finally:
        versions.append = append
    assert table() == [("a", 10), ("b", 10), ("c", 10), ("known", 0)]
    run()
    assert table() == [("a", 10), ("b", 10), ("c", 10), ("known", 0)]
    land([("a", 1), ("d", 1), ("c", 0)])
    run()
    assert table() == [("a", 10), ("b", 10), ("c", 10), ("d", 10), ("known", 0)]

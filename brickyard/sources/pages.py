"""Result pages over HTTP, as a data source and as a function of a table of urls.

A page that cannot be read is a row with an error, never a failed task: only what is wrong with the
request itself raises.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from http.client import HTTPException
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from brickyard.functions import fixed
from brickyard.sources.listings import result_pages, search_pages

SCHEMA = "ord int, source string, city string, page int, url string, base_url string, status int, attempts int, error string, html string"
_ANSWER = ("status", "attempts", "error", "html")
_GIVEN = ("ord", "source", "city", "page", "url", "base_url")


class Fetcher:
    """Gets pages: seconds to wait for an answer, tries, and a pause before each page and, doubled each time, between tries."""

    def __init__(self, timeout: float = 30.0, tries: int = 3, pause: float = 0.0, user_agent: str = fixed.USER_AGENT):
        self.timeout, self.tries, self.pause = timeout, max(int(tries), 1), pause
        self.headers = {"User-Agent": user_agent, "Accept-Language": fixed.ACCEPT_LANGUAGE}

    def get(self, url: str | None, body: bool = True) -> tuple[int | None, int, str | None, str | None]:
        """(status, attempts, error, html); without ``body`` the answer's text is not read.

        No answer, too many requests and a server's own errors are tried again; other refusals are not.
        """
        if not url:
            return None, 0, "no url", None
        time.sleep(self.pause)
        status, error = None, None
        for k in range(1, self.tries + 1):
            try:
                with urlopen(Request(url, headers=self.headers), timeout=self.timeout) as answer:
                    text = answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace") if body else None
                    return answer.status, k, None, text
            except HTTPError as e:
                status, error = e.code, f"HTTP {e.code}"
                if e.code != 429 and e.code < 500:
                    return status, k, error, None
            except (OSError, HTTPException, LookupError) as e:
                status, error = None, f"{type(e).__name__}: {e}"
            except ValueError as e:
                return None, k, f"{type(e).__name__}: {e}", None
            if k < self.tries:
                time.sleep(self.pause * 2**k)
        return status, self.tries, error, None


class _Page(InputPartition):
    def __init__(self, row: dict):
        self.row = row


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, rows: list[dict], fetcher: Fetcher):
        self.names, self.rows, self.fetcher = schema.names, rows, fetcher

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equalities on what is known beforehand pick the pages that are asked for; Spark tests the rest."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is None or len(f.attribute) != 1 or f.attribute[0] not in _GIVEN:
                yield f
            else:
                self.rows = [r for r in self.rows if r[f.attribute[0]] in wanted]

    def partitions(self) -> list[InputPartition]:
        return [_Page(r) for r in self.rows] or [_Page({})]

    def read(self, partition: _Page) -> Iterator[tuple]:
        if partition.row:
            asked = any(n in self.names for n in _ANSWER)
            status, attempts, error, html = self.fetcher.get(partition.row["url"], "html" in self.names) if asked else (None, 0, None, None)
            whole = partition.row | dict(zip(_ANSWER, (status, attempts, error, html)))
            yield tuple(whole[n] for n in self.names)


class ResultPages(DataSource):
    """``spark.read.format("result_pages")``: one task for each page.

    Options: ``pages``, a JSON list of objects (ord, source, city, page, url, base_url); timeout, tries, pause. A schema
    given by the user picks columns: without ``html`` no text is read, without any of the answer's columns no page is asked for.
    """

    @classmethod
    def name(cls) -> str:
        return "result_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        o = self.options
        rows = [{n: r.get(n) for n in _GIVEN} for r in json.loads(o.get("pages", "[]"))]
        if unknown := set(schema.names) - {*_GIVEN, *_ANSWER}:
            raise ValueError(f"result pages have no {sorted(unknown)}")
        return _Reader(schema, rows, Fetcher(float(o.get("timeout", 30)), int(o.get("tries", 3)), float(o.get("pause", 0))))


def scan_pages(spark: SparkSession, most: int = 1, pages: DataFrame | None = None, columns: str | None = None, **options: object) -> DataFrame:
    """The first ``most`` result pages of each search page that can be read (fixed ones, or ``pages``: pos, source, city, url, base_url).

    Search pages are a short list of settings and pass through the driver; ``columns`` is a schema that picks some of SCHEMA.
    """
    spark.dataSource.register(ResultPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    listed = pages if pages is not None else search_pages(spark).where("collectable")
    every = result_pages(listed, most).select("pos", "source", "city", "page", F.col("page_url").alias("url"), "base_url").orderBy("pos", "page").collect()
    asked = json.dumps([{"ord": k, **{n: r[n] for n in _GIVEN[1:]}} for k, r in enumerate(every)])
    reader = spark.read.format("result_pages").option("pages", asked).options(**{k: str(v) for k, v in options.items()})
    return (reader.schema(columns) if columns else reader).load()


def fetched(rows: DataFrame, url_col: str = "url", **options: float) -> DataFrame:
    """``rows`` with status, attempts, error and html of the page that each one names, asked for where the row is.

    For tables of any size; a lost task asks for its pages again. A null or empty url is an error of its own.
    """
    fetcher = Fetcher(**options)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(0, len(f), 16):
                some = f.iloc[k : k + 16]
                got = pd.DataFrame([fetcher.get(u) for u in some[url_col]], columns=["status", "attempts", "error", "html"], index=some.index).astype({"status": "Int64"})
                yield pd.concat([some, got], axis=1)

    schema = StructType([*rows.schema, *StructType.fromDDL("status int, attempts int, error string, html string")])
    return rows.mapInPandas(work, schema)

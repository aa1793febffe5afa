"""A table as a tab of an online spreadsheet: written beside the old tab by all tasks, put in its place at once.

Each task fills a hidden tab of its own. The commit is one batch of requests, which the service applies
as a whole: a new tab with a header, the tasks' cells copied in order, the old tab gone, the new one
named and formatted. Where a task fails, the old tab is untouched and the hidden ones are deleted; what a task that
outlived its job still adds goes with the next write. One job writes a tab at a time.
"""

from __future__ import annotations

import itertools
import json
import random
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote
from urllib.request import Request, urlopen

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from brickyard.functions import fixed


class Service:
    """The few calls of the spreadsheet service that are needed."""

    def __init__(self, endpoint: str, sheet: str, token: str | None, timeout: float = 60.0):
        found = re.search(fixed.SHEET_URL, sheet)
        self.root = f"{endpoint.rstrip('/')}/v4/spreadsheets/{found[1] if found else sheet}"
        self.token, self.timeout = token, timeout

    def _call(self, path: str, body: dict | None = None) -> dict:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        data = None if body is None else json.dumps(body).encode()
        with urlopen(Request(self.root + path, data=data, headers=headers, method="GET" if body is None else "POST"), timeout=self.timeout) as answer:
            return json.loads(answer.read() or b"{}")

    def tabs(self) -> dict[str, int]:
        return {s["properties"]["title"]: s["properties"]["sheetId"] for s in self._call("")["sheets"]}

    def batch(self, requests: list[dict]) -> None:
        self._call(":batchUpdate", {"requests": requests})

    def append(self, title: str, values: list[list[str]]) -> None:
        self._call(f"/values/{quote(title)}!A1:append?valueInputOption=USER_ENTERED&insertDataOption=INSERT_ROWS", {"values": values})


@dataclass
class _Part(WriterCommitMessage):
    partition: int
    tab: int
    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, service: Service, tab: str, columns: list[str]):
        self.service, self.tab, self.columns = service, tab, columns
        self.hidden = f".{tab}."
        self.job = f"{self.hidden}{uuid.uuid4().hex[:12]}"

    def write(self, rows: Iterator[Row]) -> _Part:
        """One task's rows in a hidden tab of its own, some at a time."""
        task = TaskContext.get()
        tab, n, made = random.randrange(1, 1 << 30), 0, False
        title = f"{self.job}.{task.partitionId()}.{task.taskAttemptId()}"
        while some := list(itertools.islice(rows, fixed.SHEET_BATCH)):
            if not made:
                self.service.batch([{"addSheet": {"properties": {"sheetId": tab, "title": title, "hidden": True, "gridProperties": {"rowCount": 1, "columnCount": len(self.columns)}}}}])
                made = True
            self.service.append(title, [["" if v is None else str(v) for v in r] for r in some])
            n += len(some)
        return _Part(task.partitionId(), tab, n)

    def _leftovers(self) -> list[dict]:
        return [{"deleteSheet": {"sheetId": k}} for title, k in self.service.tabs().items() if title.startswith(self.hidden)]

    def commit(self, messages: list[_Part | None]) -> None:
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.partition)
        total, width = sum(p.rows for p in parts) + 1, len(self.columns)
        if total * width > fixed.SHEET_CELLS:
            self.abort(messages)
            raise ValueError(f"{total} rows of {width} columns are more than a spreadsheet holds")
        new, old = random.randrange(1, 1 << 30), self.service.tabs().get(self.tab)

        def area(tab: int, first: int, last: int) -> dict:
            return {"sheetId": tab, "startRowIndex": first, "endRowIndex": last, "startColumnIndex": 0, "endColumnIndex": width}

        head = [{"userEnteredValue": {"stringValue": c}} for c in self.columns]
        requests: list[dict] = [
            {"addSheet": {"properties": {"sheetId": new, "title": f"{self.job}.new", "gridProperties": {"rowCount": total, "columnCount": width}}}},
            {"updateCells": {"range": area(new, 0, 1), "rows": [{"values": head}], "fields": "userEnteredValue"}},
        ]
        at = 1
        for p in parts:
            requests.append({"copyPaste": {"source": area(p.tab, 0, p.rows), "destination": area(new, at, at + p.rows), "pasteType": "PASTE_NORMAL"}})
            at += p.rows
        requests += self._leftovers()
        if old is not None:
            requests.append({"deleteSheet": {"sheetId": old}})
        look = {"backgroundColor": dict(zip(("red", "green", "blue"), fixed.SHEET_HEADER_COLOR)), "textFormat": {"bold": True}}
        requests += [
            {"updateSheetProperties": {"properties": {"sheetId": new, "title": self.tab, "gridProperties": {"frozenRowCount": 1}}, "fields": "title,gridProperties.frozenRowCount"}},
            {"repeatCell": {"range": area(new, 0, 1), "cell": {"userEnteredFormat": look}, "fields": "userEnteredFormat(backgroundColor,textFormat)"}},
            {"setBasicFilter": {"filter": {"range": area(new, 0, total)}}},
            {"autoResizeDimensions": {"dimensions": {"sheetId": new, "dimension": "COLUMNS", "startIndex": 0, "endIndex": width}}},
        ]
        self.service.batch(requests)

    def abort(self, messages: list[_Part | None]) -> None:
        if gone := self._leftovers():
            self.service.batch(gone)


class Sheet(DataSource):
    """``df.write.format("sheet").mode("overwrite")``; options: sheet (id or address), tab, token, endpoint."""

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if not overwrite:
            raise ValueError("a tab is replaced as a whole: write in mode overwrite")
        o = self.options
        return _Writer(Service(o.get("endpoint", fixed.SHEET_ENDPOINT), o["sheet"], o.get("token")), o["tab"], schema.names)


def write_sheet(rows: DataFrame, sheet: str, tab: str, token: str | None = None, endpoint: str | None = None) -> None:
    """Replace a tab by a table, in the order of its partitions (sort it first where order matters); nulls are empty cells."""
    rows.sparkSession.dataSource.register(Sheet)
    options = {"sheet": sheet, "tab": tab, "token": token, "endpoint": endpoint}
    texts = rows.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns))
    texts.write.format("sheet").options(**{k: v for k, v in options.items() if v is not None}).mode("overwrite").save()

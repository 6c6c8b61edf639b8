"""Getting lists in and results out: tables in HTML, calendars with gaps, batched posting."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None


def html_table(spark: SparkSession, html: str, required: tuple[str, ...] = ("Symbol",), any_of: bool = False) -> DataFrame:
    """The first table whose header has the required columns (or any of them), all text.

    A listing page, read on the driver; ValueError if no table fits.
    """
    parser = _Tables()
    parser.feed(html)
    for rows in parser.tables:
        rows = [r for r in rows if r]
        if rows and (any if any_of else all)(c in rows[0] for c in required):
            head = rows[0]
            body = [tuple((r + [None] * len(head))[: len(head)]) for r in rows[1:]]
            return spark.createDataFrame(body, ", ".join(f"`{c}` string" for c in head))
    raise ValueError(f"no table has {', '.join(required)}")


def listed_on(day: dt.date, fetch: Callable[[dt.date], list], back: int = 6) -> tuple[dt.date, list]:
    """The list of a day or of the latest day before it, ``back`` days at most, that has one."""
    for i in range(back + 1):
        if found := fetch(day - dt.timedelta(i)):
            return day - dt.timedelta(i), found
    return day, []


def post(df: DataFrame, send: Callable[[list[dict]], None], size: int = 500, retries: int = 2, pause: float = 0.5) -> None:
    """Hand rows to a sender in chunks, from the tasks; a chunk that fails is tried again
    after a growing pause, then the task fails. A retried task sends its chunks again, so
    the receiver must take repeated rows."""

    def run(rows):
        chunk = []

        def flush():
            for attempt in range(retries + 1):
                try:
                    send(chunk)
                    return
                except OSError:
                    if attempt == retries:
                        raise
                    time.sleep(pause * (attempt + 1))

        for row in rows:
            chunk.append(row.asDict(recursive=True))
            if len(chunk) == size:
                flush()
                chunk = []
        if chunk:
            flush()

    df.foreachPartition(run)

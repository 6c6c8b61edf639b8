"""A Python data source for quote services: one partition for each page of symbols.

The transport is a function from a request path to JSON text. The one that ships reads
files, so tests and replays need no network; a live one is an option of the reader. A
request that fails is tried again with a growing pause.
"""

from __future__ import annotations

import importlib
import json
import time

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def file_transport(base: str, path: str) -> str:
    with open(f"{base}/{path}.json", encoding="utf-8") as f:
        return f.read()


class _Symbols(InputPartition):
    def __init__(self, symbols):
        self.symbols = symbols


class QuoteReader(DataSourceReader):
    """Options: base; symbols (comma-separated); page; transport ("module:function"); retries."""

    FIELDS = ("open", "high", "low", "close", "volume")

    def __init__(self, options):
        self.options = options
        module, _, name = options.get("transport", f"{__name__}:file_transport").partition(":")
        self.where = (module, name)

    def partitions(self):
        symbols, page = [s for s in self.options["symbols"].split(",") if s], int(self.options.get("page", 100))
        return [_Symbols(symbols[i : i + page]) for i in range(0, len(symbols), page)] or [_Symbols([])]

    def read(self, partition):
        fetch = getattr(importlib.import_module(self.where[0]), self.where[1])
        rows = []
        for symbol in partition.symbols:
            for bar in json.loads(self.tried(fetch, symbol)).get("bars", []):
                rows.append((symbol, bar.get("session"), *[None if bar.get(f) is None else float(bar[f]) for f in self.FIELDS]))
        if rows:
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), *[pa.array(c, pa.float64()) for c in cols[2:]]], names=["instrument", "session", *self.FIELDS])

    def tried(self, fetch, symbol: str) -> str:
        for attempt in range(int(self.options.get("retries", 3))):
            try:
                return fetch(self.options["base"], symbol)
            except OSError as e:
                failure = e
                time.sleep(0.05 * (attempt + 1))
        raise failure


class QuoteSource(DataSource):
    @classmethod
    def name(cls):
        return "tidemark_quotes"

    def schema(self):
        return "instrument string, session string, open double, high double, low double, close double, volume double"

    def reader(self, schema):
        return QuoteReader(self.options)

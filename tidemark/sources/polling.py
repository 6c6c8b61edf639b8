"""A stream of bars from a service that is polled: a Python streaming data source.

The service numbers its deliveries; an offset is the last number that a batch takes. A batch
is planned as pages of symbols over a range of numbers, so a batch that is planned again
after a failure or a restart reads the same deliveries: none is lost, none comes twice. A
request that fails is tried again with a pause that doubles up to a bound.

The transport is a function from a request path to JSON text. The one that ships reads
files: ``latest`` gives {"seq": n}, a symbol gives {"bars": [{"seq": n, "session": ...}]}.
"""

from __future__ import annotations

import importlib
import json
import random
import time

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FIELDS = ("open", "high", "low", "close", "volume")


class Page(InputPartition):
    def __init__(self, symbols: list[str], after: int, until: int):
        self.symbols, self.after, self.until = symbols, after, until


def tried(fetch, path: str, retries: int, pause: float, most: float):
    """The result of a request, after pauses that double from ``pause`` up to ``most`` seconds and vary
    by a quarter, so that tasks which fail together don't come back together."""
    for attempt in range(retries):
        try:
            return fetch(path)
        except OSError:
            if attempt + 1 == retries:
                raise
            time.sleep(min(most, pause * 2**attempt) * random.uniform(0.75, 1.25))


class PollReader(DataSourceStreamReader):
    """Options: base; symbols (comma-separated); page; start (the number before the first delivery,
    0 unless given); transport ("module:function"); retries; pause; most_pause."""

    def __init__(self, options):
        self.options = options
        self.where = options.get("transport", "tidemark.sources.quotes:file_transport")

    def _get(self, path: str) -> dict:
        module, _, name = self.where.partition(":")
        fetch = getattr(importlib.import_module(module), name)
        o = self.options
        return json.loads(tried(lambda p: fetch(o["base"], p), path, int(o.get("retries", 4)), float(o.get("pause", 0.2)), float(o.get("most_pause", 10))))

    def initialOffset(self) -> dict:
        return {"seq": int(self.options.get("start", 0))}

    def latestOffset(self) -> dict:
        return {"seq": int(self._get("latest")["seq"])}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        symbols, page = [s for s in self.options["symbols"].split(",") if s], int(self.options.get("page", 100))
        return [Page(symbols[i : i + page], start["seq"], end["seq"]) for i in range(0, len(symbols), page)]

    def read(self, partition: Page):
        rows = []
        for symbol in partition.symbols:
            for bar in self._get(symbol).get("bars", []):
                if partition.after < int(bar["seq"]) <= partition.until:
                    rows.append((symbol, bar.get("session"), *[None if bar.get(f) is None else float(bar[f]) for f in FIELDS], int(bar["seq"])))
        if rows:
            cols = list(zip(*rows, strict=True))
            kinds = [pa.string(), pa.string(), *[pa.float64()] * len(FIELDS), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["instrument", "session", *FIELDS, "delivered_at"])

    def commit(self, end: dict) -> None:
        """Nothing to do: the service keeps its deliveries."""


class PollSource(DataSource):
    @classmethod
    def name(cls):
        return "tidemark_poll"

    def schema(self):
        return "instrument string, session string, " + ", ".join(f"{f} double" for f in FIELDS) + ", delivered_at long"

    def streamReader(self, schema):
        return PollReader(self.options)


def polled(spark, **options):
    """The stream; ``delivered_at`` is the number of the delivery."""
    spark.dataSource.register(PollSource)
    return spark.readStream.format("tidemark_poll").options(**options).load()

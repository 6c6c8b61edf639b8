"""Smoothing of bars that may be corrected later: a correction changes all levels after it.

The state of an instrument holds its bars of the last ``horizon`` with their levels, and the
level before them. A batch puts its bars in, takes the level before the first that changed,
and goes on from there; what comes out are the bars whose level is new or other than before.
When the watermark passes a bar, a timer folds it into the level before. Bars that come
after that are dropped by the watermark, which Spark counts as rows dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.folders import shared

LEVEL = "level double, started boolean"


def advanced(level: float, started: bool, value: float | None, alpha: float) -> tuple[float, bool]:
    """The level after a bar; a null value carries it on."""
    if value is None or pd.isna(value):
        return level, started
    return (level * (1 - alpha) + value * alpha, True) if started else (float(value), True)


class Corrected(StatefulProcessor):
    def __init__(self, alpha: float, order: str):
        self.alpha, self.order = alpha, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getMapState("bars", "at long", "value double, version long, level double, started boolean")
        self.before = handle.getValueState("before", LEVEL)
        self.due = handle.getValueState("due", "at long")

    def _base(self) -> tuple[float, bool]:
        return tuple(self.before.get()) if self.before.exists() else (0.0, False)

    def _held(self) -> dict[int, tuple]:
        return {k[0]: tuple(v) for k, v in self.bars.iterator()} if self.bars.exists() else {}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        first, touched = None, set()
        new = pd.concat(list(rows))
        for at, value, version in sorted(zip(_micros(new["ts"]), new["close"], new[self.order], strict=True), key=lambda r: (r[0], r[2])):
            value = None if pd.isna(value) else float(value)
            if at not in held or held[at][1] <= version:  # the last delivery wins
                if at not in held or held[at][0] != value:
                    first = at if first is None else min(first, at)
                    touched.add(at)
                old = held.get(at)
                held[at] = (value, int(version), *(old[2:] if old else (0.0, False)))
                if at not in touched:
                    self.bars.updateValue((at,), held[at])
        out = []
        if first is not None:
            times = sorted(held)
            start = times.index(first)
            level, started = held[times[start - 1]][2:] if start else self._base()
            for at in times[start:]:
                value, version, was, had = held[at]
                level, started = advanced(level, started, value, self.alpha)
                if at in touched or (level, started) != (was, had):
                    self.bars.updateValue((at,), (value, version, level, started))
                    out.append((key[0], at, value, level if started else None, version))
        if held:
            self._watch(min(held))
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        self.due.clear()
        held = self._held()
        for at in sorted(held):
            if at > now:
                self._watch(at)
                break
            self.before.update(held[at][2:])
            self.bars.removeKey((at,))
        yield _frame([])

    def _watch(self, at: int) -> None:
        """One timer for the oldest bar."""
        due = -(-at // 1000)
        if self.due.exists():
            if (old := self.due.get()[0]) == due:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(due)
        self.due.update((due,))

    def close(self) -> None:
        pass


def _micros(ts: pd.Series) -> list[int]:
    return [int(t.value // 1000) for t in pd.to_datetime(ts)]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=["instrument", "ts", "close", "ema", "version"])
    df["ts"] = pd.to_datetime(df["ts"].astype("int64"), unit="us")
    return df.astype({"close": float, "ema": float, "version": "int64"})


def smoothed(bars: DataFrame, alpha: float, horizon: str = "1200 days", order: str = "delivered_at") -> DataFrame:
    """instrument, ts, close, ema, version of every bar that is new or whose level changed.

    ``bars``: instrument, ts, close and ``order``, the greater of which replaces a bar of the
    same time; of equal ones the later row does. The last row of a bar is what a batch over the
    bars' last deliveries gives. Needs the RocksDB state store (see ``state_store``).
    """
    rows = bars.select("instrument", "ts", bars["close"].cast("double").alias("close"), bars[order].cast("long").alias(order)).withWatermark("ts", horizon)
    schema = "instrument string, ts timestamp, close double, ema double, version long"
    return rows.groupBy("instrument").transformWithStateInPandas(Corrected(alpha, order), schema, "Update", "EventTime")


STORE = "spark.sql.streaming.stateStore.providerClass"


def state_store(spark: SparkSession) -> None:
    """State with maps and timers is kept in RocksDB."""
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def latest(rows: DataFrame) -> DataFrame:
    """Of each bar the row that came out of the last batch (``batch``) that gave one."""
    newest = Window.partitionBy("instrument", "ts").orderBy(F.desc("batch"))
    return rows.withColumn("_k", F.row_number().over(newest)).where("_k = 1").drop("_k")


def replayed(spark: SparkSession, first: DataFrame, later: DataFrame, alpha: float, horizon: str = "36500 days") -> DataFrame:
    """Two deliveries streamed one after the other, and the last level of each bar: what a store of
    the stream's output holds. Deliveries and results are files in the shared folder."""
    before = spark.conf.get(STORE)
    state_store(spark)
    folder = shared(spark, "deliveries")
    try:
        for rows in (first, later):
            rows.write.mode("append").parquet(f"{folder}/in")
            out = smoothed(spark.readStream.schema(first.schema).parquet(f"{folder}/in"), alpha, horizon)
            sink = lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{folder}/out/step={batch}")
            out.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    return latest(spark.read.parquet(f"{folder}/out"))

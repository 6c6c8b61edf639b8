"""Incremental upkeep of bars: ticks to bars, upserts, smoothing and first touches with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.cleaning import upsert


def tick_bars(ticks: DataFrame, late: str = "1 day", width: str = "1 day", offset: str | None = None) -> DataFrame:
    """Tumbling bars of ticks (instrument, ts, price, size); windows close when the watermark passes."""
    window = F.window("ts", width, None, offset) if offset else F.window("ts", width)
    order = F.struct("ts", "price")
    return (
        ticks.withWatermark("ts", late)
        .groupBy("instrument", window.alias("w"))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"))
        .select("instrument", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")
    )


def weekly_bars(ticks: DataFrame, late: str = "7 days") -> DataFrame:
    """Weeks from Saturday to Friday (windows count from a Thursday)."""
    return tick_bars(ticks, late, "7 days", "2 days")


def once(ticks: DataFrame, key: list[str], late: str = "1 day") -> DataFrame:
    """Exact redeliveries within the watermark come once."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


class BarStore:
    """Bars in Parquet by day; a batch of deliveries writes anew the days that it touches.

    ``v<batch>`` holds the days of a batch, ``m<batch>`` the list of all days and the batch
    that wrote each last. A list is complete before it counts, and a batch that was applied
    is skipped when it comes again, so a restarted stream changes nothing twice. What a
    batch costs follows the days it touches, not the store; the lists hold a row a day.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, day: str = "session"):
        self.spark, self.path, self.schema, self.day = spark, path, schema, day

    def _hadoop(self, name: str = ""):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _versions(self) -> list[int]:
        fs, path = self._hadoop()
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[1:]) for n in names if n.startswith("m") and fs.exists(self._hadoop(f"{n}/_SUCCESS")[1]))

    def _days(self) -> dict[str, int]:
        """Day to the batch that wrote it last."""
        found = self._versions()
        return {r.day: r.batch for r in self.spark.read.schema("day string, batch long").json(f"{self.path}/m{found[-1]}").collect()} if found else {}

    def read(self, days: set[str] | None = None) -> DataFrame:
        paths = [f"{self.path}/v{v}/_day={d}" for d, v in self._days().items() if days is None or d in days]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def apply(self, delivered: DataFrame, batch_id: int, order: str = "delivered_at") -> None:
        if batch_id in self._versions():
            return
        day = F.coalesce(F.col(self.day).cast("date").cast("string"), F.lit("none"))
        touched = {r[0] for r in delivered.select(day).distinct().collect()}  # a row a day
        rows = upsert(self.read(touched), delivered, order).withColumn("_day", day)
        rows.write.mode("overwrite").partitionBy("_day").parquet(f"{self.path}/v{batch_id}")
        now = self._days() | dict.fromkeys(touched, batch_id)
        self.spark.createDataFrame(sorted(now.items()), "day string, batch long").coalesce(1).write.mode("overwrite").json(f"{self.path}/m{batch_id}")

    def vacuum(self) -> None:
        """Delete the days and lists that the newest list no longer names; not while others read them."""
        versions, used = self._versions(), {f"v{v}/_day={d}" for d, v in self._days().items()}
        for v in versions[:-1]:
            fs, path = self._hadoop(f"m{v}")
            fs.delete(path, True)
        for v in versions:
            fs, path = self._hadoop(f"v{v}")
            for s in fs.listStatus(path) if fs.exists(path) else []:
                name = s.getPath().getName()
                if name.startswith("_day=") and f"v{v}/{name}" not in used:
                    fs.delete(s.getPath(), True)

    def sink(self, order: str = "delivered_at"):
        """For writeStream.foreachBatch."""
        return lambda batch, batch_id: self.apply(batch, batch_id, order)


def smooth_stream(bars: DataFrame, alpha: float, value: str = "close", order: str = "ts") -> DataFrame:
    """An exponential average with state per instrument: instrument, ts, value, ema.

    Rows of a batch are taken in order; a null value carries the level on. A corrected
    bar changes all later levels: replay from it in foreachBatch, as the batch fold does.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, started = state.get if state.exists else (0.0, False)
        rows = pd.concat(list(frames)).sort_values(order)
        out = []
        for x in rows[value]:
            if pd.notna(x):
                level, started = (level * (1 - alpha) + x * alpha, True) if started else (float(x), True)
            out.append(level if started else None)
        state.update((float(level), bool(started)))
        yield pd.DataFrame({"instrument": key[0], order: rows[order].values, value: rows[value].values, "ema": pd.Series(out, dtype=float).values})

    kind = bars.schema[order].dataType.simpleString()
    return bars.groupBy("instrument").applyInPandasWithState(step, f"instrument string, {order} {kind}, {value} double, ema double", "level double, started boolean", "append", GroupStateTimeout.NoTimeout)


def watch_stream(prices: DataFrame, target: float, stop: float) -> DataFrame:
    """First touch of a target or stop (percent against the first price seen): one row per
    instrument when it happens, nothing after. At one tick below the stop the stop counts."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        base, done = state.get if state.exists else (None, False)
        rows = pd.concat(list(frames)).sort_values("ts")
        out = []
        for ts, price in zip(rows.ts, rows.price, strict=True):
            if done or pd.isna(price):
                continue
            if base is None:
                base = float(price)
                continue
            change = (price - base) / base * 100
            if change <= stop or change >= target:
                out.append((key[0], ts, "stop" if change <= stop else "target", change))
                done = True
        if base is not None:
            state.update((float(base), bool(done)))
        yield pd.DataFrame(out, columns=["instrument", "ts", "event", "change"])

    return prices.groupBy("instrument").applyInPandasWithState(step, "instrument string, ts timestamp, event string, change double", "base double, done boolean", "append", GroupStateTimeout.NoTimeout)

"""Streams equal the batch operators; redeliveries and restarts change nothing twice."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from tidemark.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
TICK = "instrument string, ts timestamp, price double, size int"


def stream(spark, path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def ticks(n=200):
    return [("AB"[i % 2], T0 + dt.timedelta(minutes=37 * i), float((i * 7919) % 101), 1 + i % 3) for i in range(n)]


def test_tick_bars_equal_batch(spark, tmp_path):
    rows = ticks()
    live = drained(jobs.tick_bars(stream(spark, tmp_path / "t", [rows[:90], rows[90:]], TICK)), "tick_bars")
    batch = jobs.tick_bars(spark.createDataFrame(rows, TICK))
    got, want = {tuple(r) for r in live.collect()}, {tuple(r) for r in batch.collect()}
    assert got and got <= want and len(want - got) <= 6  # windows that the watermark hasn't closed


def test_redeliveries_come_once(spark, tmp_path):
    rows = ticks(20)
    out = drained(jobs.once(stream(spark, tmp_path / "r", [rows, rows[:10]], TICK), ["instrument", "ts"]), "redelivered")
    assert out.count() == 20


def test_store_applies_a_batch_once(spark, tmp_path):
    schema = "instrument string, session date, close double, delivered_at int"
    store = jobs.BarStore(spark, str(tmp_path / "store"), schema)
    day = dt.date(2024, 1, 1)
    df = stream(spark, tmp_path / "d", [[("A", day, 1.0, 0)], [("A", day, 2.0, 1), ("B", day, 5.0, 1)]], schema)
    for _ in range(2):  # a restart finds nothing new
        q = df.writeStream.foreachBatch(store.sink()).option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
    got = sorted((r.instrument, r.close) for r in store.read().collect())
    assert [g[0] for g in got] == ["A", "B"] and got[0][1] == 2.0
    store.apply(spark.createDataFrame([("A", day, 9.0, 9)], schema), 0)
    assert sorted((r.instrument, r.close) for r in store.read().collect()) == got


def test_store_writes_touched_days_only(spark, tmp_path):
    schema = "instrument string, session date, close double, delivered_at int"
    store = jobs.BarStore(spark, str(tmp_path / "store"), schema)
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(5)]
    store.apply(spark.createDataFrame([(n, d, 1.0, 0) for n in "AB" for d in days], schema), 0)
    store.apply(spark.createDataFrame([("A", days[3], 7.0, 1), ("C", dt.date(2024, 2, 1), 8.0, 1), ("D", None, 9.0, 1)], schema), 1)
    written = sorted(p.name for p in (tmp_path / "store" / "v1").iterdir() if p.name.startswith("_day="))
    assert written == ["_day=2024-01-04", "_day=2024-02-01", "_day=none"]
    want = {(n, d): 1.0 for n in "AB" for d in days} | {("A", days[3]): 7.0, ("C", dt.date(2024, 2, 1)): 8.0, ("D", None): 9.0}
    for _ in range(2):
        assert {(r.instrument, r.session): r.close for r in store.read().collect()} == want and store.read().count() == len(want)
        store.vacuum()
    assert not (tmp_path / "store" / "m0").exists() and len([p for p in (tmp_path / "store" / "v0").iterdir() if p.name.startswith("_day=")]) == 4


def test_smoothing_with_state(spark, tmp_path):
    rows = [("A", T0 + dt.timedelta(hours=i), float(i * i % 17) if i != 4 else None) for i in range(20)]
    schema = "instrument string, ts timestamp, close double"
    spark.createDataFrame(rows[:8], schema).coalesce(1).write.parquet(str(tmp_path / "s"))
    df = spark.readStream.schema(schema).parquet(str(tmp_path / "s"))
    q = jobs.smooth_stream(df, 0.25).writeStream.format("memory").queryName("smooth").outputMode("append").start()
    q.processAllAvailable()
    spark.createDataFrame(rows[8:], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    q.processAllAvailable()
    q.stop()
    got = [r.ema for r in spark.table("smooth").orderBy("ts").collect()]
    want = pd.Series([r[2] for r in rows], dtype=float).ewm(alpha=0.25, adjust=False, ignore_na=True).mean()
    assert max(abs(a - b) for a, b in zip(got, want, strict=True)) < 1e-12


def test_first_touch_with_state(spark, tmp_path):
    rows = [("A", T0, 100.0), ("A", T0 + dt.timedelta(1), 105.0), ("A", T0 + dt.timedelta(2), 111.0), ("A", T0 + dt.timedelta(3), 50.0), ("B", T0, 10.0), ("B", T0 + dt.timedelta(1), 9.0)]
    df = stream(spark, tmp_path / "w", [rows], "instrument string, ts timestamp, price double")
    got = {r.instrument: r.event for r in drained(jobs.watch_stream(df, 10.0, -6.0), "watched").collect()}
    assert got == {"A": "target", "B": "stop"}


def test_windows_of_a_batch(spark):
    week = jobs.weekly_bars(spark.createDataFrame([("A", dt.datetime(2024, 1, d), 1.0, 1) for d in (5, 6, 8, 12)], TICK)).orderBy("start").collect()
    assert [(r.start.date(), r.volume) for r in week] == [(dt.date(2023, 12, 30), 1), (dt.date(2024, 1, 6), 3)]
    assert week[0].asDict().keys() >= {"open", "close"} and F is not None

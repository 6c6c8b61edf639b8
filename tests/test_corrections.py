"""Corrected bars in a stream give what a batch over the last deliveries gives."""

import datetime as dt
import json
import random

import pandas as pd
import pytest

from tidemark.sources import polling
from tidemark.streaming import corrections, jobs

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "instrument string, ts timestamp, close double, delivered_at int"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    corrections.state_store(spark)
    yield
    spark.conf.set(name, before)


def run(spark, tmp_path, batches, horizon="1200 days", alpha=0.25):
    """Rows that come out, batch by batch."""
    folder = str(tmp_path / "in")
    out = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        df = corrections.smoothed(spark.readStream.schema(SCHEMA).parquet(folder), alpha, horizon)
        got = []
        q = df.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda b, _, got=got: got.extend(b.collect())).trigger(availableNow=True).start()
        q.awaitTermination()
        out.append((got, q.lastProgress))
    return out


def batch(rows, alpha=0.25):
    df = pd.DataFrame(rows, columns=["instrument", "ts", "close", "delivered_at"]).sort_values(["instrument", "ts", "delivered_at"], kind="stable").drop_duplicates(["instrument", "ts"], keep="last")
    out = {}
    for name, part in df.groupby("instrument"):
        levels = part.close.ewm(alpha=alpha, adjust=False, ignore_na=True).mean()
        out |= {(name, t): e for t, e in zip(part.ts, levels, strict=True)}
    return out


def test_corrections_recompute_what_follows(spark, tmp_path, rocks):
    rng = random.Random(1)
    first = [(n, T0 + dt.timedelta(i), float(rng.randint(1, 99)) if i % 7 else None, 0) for n in "AB" for i in range(30)]
    later = [("A", T0 + dt.timedelta(10), 500.0, 1), ("A", T0 + dt.timedelta(30), 7.0, 1), ("A", T0 + dt.timedelta(10), 400.0, 2), ("B", T0 + dt.timedelta(-3), 1.0, 1)]
    stale = [("A", T0 + dt.timedelta(10), 999.0, 1), ("B", T0 + dt.timedelta(5), None, 3)]
    out = run(spark, tmp_path, [first, later, stale])
    held = {}
    for got, _ in out:
        held |= {(r.instrument, r.ts): r.ema for r in got}
    want = batch(first + later + [r for r in stale if r[2] is None])
    assert set(held) == set(want)
    assert all((pd.isna(want[k]) and v is None) or v == pytest.approx(want[k], abs=1e-12) for k, v in held.items())
    changed = {(r.instrument, r.ts) for r in out[1][0]}
    assert all(t >= T0 + dt.timedelta(10) for n, t in changed if n == "A") and ("A", T0 + dt.timedelta(29)) in changed
    assert {n for n, _ in {(r.instrument, r.ts) for r in out[2][0]}} == {"B"}  # an older delivery changes nothing


def test_bars_behind_the_horizon_become_the_level_before(spark, tmp_path, rocks):
    days = lambda a, b: [("A", T0 + dt.timedelta(i), float(i * i % 23), 0) for i in range(a, b)]
    batches = [days(0, 10), days(10, 20), days(20, 30), days(30, 31), [("A", T0 + dt.timedelta(2), 1000.0, 9), ("A", T0 + dt.timedelta(27), 50.0, 9)]]
    out = run(spark, tmp_path, batches, "5 days")
    held = {}
    for got, _ in out:
        held |= {r.ts: r.ema for r in got}
    want = batch(sum(batches[:4], []) + batches[4][1:])
    assert all(held[t] == pytest.approx(want["A", t], abs=1e-12) for _, t in want)
    dropped = sum(s["numRowsDroppedByWatermark"] for _, p in out[-1:] for s in json.loads(json.dumps(p.get("stateOperators", []), default=lambda o: o.__dict__)) if "numRowsDroppedByWatermark" in s)
    assert dropped == 1 and {r.ts for r in out[-1][0]} == {T0 + dt.timedelta(i) for i in range(27, 31)}


def deliver(base, seq, bars):
    """Adds bars (symbol, session, close) as the deliveries from seq + 1 on."""
    for symbol, session, close in bars:
        seq += 1
        path = base / f"{symbol}.json"
        held = json.loads(path.read_text()) if path.exists() else {"bars": []}
        held["bars"].append({"seq": seq, "session": session, "close": close})
        path.write_text(json.dumps(held))
    (base / "latest.json").write_text(json.dumps({"seq": seq}))
    return seq


def flaky(base, path):
    """Fails for symbols that a file names, for good."""
    import pathlib

    names = pathlib.Path(base) / "broken"
    if names.exists() and path in names.read_text().split():
        raise OSError(f"no answer for {path}")
    return (pathlib.Path(base) / f"{path}.json").read_text()


def poll(spark, base, out, checkpoint):
    df = polling.polled(spark, base=str(base), symbols="A,B,C,D,E", page="2", transport="test_corrections:flaky", retries="2", pause="0.01")
    q = df.writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start(str(out))
    q.awaitTermination()


def test_restart_in_mid_poll_loses_and_repeats_nothing(spark, tmp_path, monkeypatch):
    import os

    here = os.path.dirname(os.path.abspath(__file__))
    monkeypatch.setitem(spark.sparkContext.environment, "PYTHONPATH", os.pathsep.join([os.path.dirname(here), here]))
    base, out, checkpoint = tmp_path / "service", tmp_path / "out", tmp_path / "checkpoint"
    base.mkdir()
    for s in "ABCDE":
        (base / f"{s}.json").write_text('{"bars": []}')
    bars = [(s, f"2024-01-{d:02d}", float(d)) for d in range(1, 5) for s in "ABCDE"]
    seq = deliver(base, 0, bars)
    poll(spark, base, out, checkpoint)
    more = [(s, "2024-01-05", 5.0) for s in "ABCDE"] + [("A", "2024-01-04", 44.0)]
    seq = deliver(base, seq, more)
    (base / "broken").write_text("D")
    with pytest.raises(Exception, match="no answer for D"):
        poll(spark, base, out, checkpoint)
    (base / "broken").unlink()
    last = [("E", "2024-01-06", 6.0)]  # comes after the batch that failed was planned
    deliver(base, seq, last)
    for _ in range(2):
        poll(spark, base, out, checkpoint)
    got = sorted((r.delivered_at, r.instrument, r.session, r.close) for r in spark.read.parquet(str(out)).collect())
    assert got == [(i, *b) for i, b in enumerate(bars + more + last, 1)]


def test_polled_bars_are_stored_with_their_corrections(spark, tmp_path, monkeypatch):
    import os

    here = os.path.dirname(os.path.abspath(__file__))
    monkeypatch.setitem(spark.sparkContext.environment, "PYTHONPATH", os.pathsep.join([os.path.dirname(here), here]))
    base = tmp_path / "service"
    base.mkdir()
    for s in "ABCDE":
        (base / f"{s}.json").write_text('{"bars": []}')
    store = jobs.BarStore(spark, str(tmp_path / "store"), "instrument string, session date, close double, delivered_at long")
    seq = 0
    for bars in ([("A", "2024-01-02", 1.0), ("B", "2024-01-02", 2.0)], [("A", "2024-01-02", 3.0), ("A", "2024-01-03", 4.0)]):
        seq = deliver(base, seq, bars)
        df = polling.polled(spark, base=str(base), symbols="A,B,C,D,E", transport="test_corrections:flaky").selectExpr("instrument", "to_date(session) AS session", "close", "delivered_at")
        q = df.writeStream.foreachBatch(store.sink()).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted((r.instrument, r.session.day, r.close) for r in store.read().collect()) == [("A", 2, 3.0), ("A", 3, 4.0), ("B", 2, 2.0)]


def test_pauses_double_up_to_a_bound(monkeypatch):
    slept, calls = [], []
    monkeypatch.setattr(polling.time, "sleep", slept.append)
    monkeypatch.setattr(polling.random, "uniform", lambda a, b: 1.0)

    def fetch(path):
        calls.append(path)
        if len(calls) < 6:
            raise OSError("busy")
        return "{}"

    assert polling.tried(fetch, "A", 6, 1.0, 5.0) == "{}" and slept == [1.0, 2.0, 4.0, 5.0, 5.0]
    with pytest.raises(OSError):
        polling.tried(lambda p: (_ for _ in ()).throw(OSError("down")), "A", 2, 0.0, 0.0)

"""Edge cases of bars, indicators, gates and labels, against pandas and by hand."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as c
from tidemark.operators import cleaning, indicators, resample, signals
from tidemark.sources import quotes, tables

DAY = dt.date(2024, 1, 1)
SCHEMA = "instrument string, session date, market string, open double, high double, low double, close double, volume double"


def frame(spark, rows, start=DAY):
    return spark.createDataFrame([("A", start + dt.timedelta(i), "even", *map(lambda x: None if x is None else float(x), r)) for i, r in enumerate(rows)], SCHEMA)


def random_bars(spark, n=300, seed=0, flat=False):
    rng = np.random.default_rng(seed)
    close = np.full(n, 50.0) if flat else 100 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))
    open_ = close if flat else close * (1 + rng.normal(0, 0.01, n))
    high, low = (np.maximum(open_, close) * (1 if flat else 1.01), np.minimum(open_, close) * (1 if flat else 0.99))
    return frame(spark, zip(open_.tolist(), high.tolist(), low.tolist(), close.tolist(), rng.integers(1, 100, n).tolist(), strict=True))


def pandas_of(df):
    return df.orderBy("session").toPandas()


def close_to(a, b, tol=1e-9):
    a, b = np.array(a, float), np.array(b, float)
    assert (np.isnan(a) == np.isnan(b)).all()
    assert np.nanmax(np.abs(a - b) / np.maximum(1, np.abs(b))) < tol


def test_halt_days(spark):
    one = cleaning.drop_halts(frame(spark, [(10, 11, 9, 10, 5), (0, 0, 0, 0, 0), (10, 12, 9, 11, 5)])).orderBy("session").collect()
    assert len(one) == 3 and (one[1].open, one[1].high, one[1].low, one[1].close) == (10, 10, 10, 10)
    two = frame(spark, [(10, 11, 9, 10, 5), (0, 0, 0, 0, 0), (0, 0, 0, 0, 0)])
    assert cleaning.drop_halts(two).count() == 2 and cleaning.drop_halts(two, chain=True).count() == 3
    bad = frame(spark, [(10, 8, 9, 10, 5), (-1, 11, 9, 10, 5), (10, 11, 9, None, 5), (10, 11, 9, float("nan"), 5), (10, float("inf"), 9, 10, 5), (10, 11, 9, 10, None)])
    assert [r.session for r in cleaning.drop_halts(bad).collect()] == []
    assert cleaning.drop_halts(bad.where("false")).count() == 0


def test_smoothing_equals_pandas(spark):
    df = pandas_of(random_bars(spark))
    got = pandas_of(indicators.smoothed(random_bars(spark)))
    cl, hi, lo = df.close, df.high, df.low
    ema = lambda s, n: s.ewm(span=n, adjust=False).mean()
    rma = lambda s: s.ewm(alpha=1 / 14, adjust=False).mean()
    macd = ema(cl, 12) - ema(cl, 26)
    close_to(got.macd_hist, macd - ema(macd, 9))
    d = cl.diff()
    close_to(got.rsi14, 100 - 100 / (1 + rma(d.clip(lower=0)) / rma((-d).clip(lower=0))))
    tr = pd.concat([hi - lo, (hi - cl.shift()).abs(), (lo - cl.shift()).abs()], axis=1).max(axis=1)
    close_to(got.atr14, rma(tr))
    up, down = hi.diff(), -lo.diff()
    pdm = pd.Series(np.where((up > down) & (up > 0), up, 0.0))
    mdm = pd.Series(np.where((down > up) & (down > 0), down, 0.0))
    pdi, mdi = 100 * rma(pdm) / rma(tr), 100 * rma(mdm) / rma(tr)
    close_to(got.plus_di, pdi)
    close_to(got.adx14, rma(100 * (pdi - mdi).abs() / (pdi + mdi)))


def test_smoothing_starts_at_the_first_value_and_keeps_nulls_apart(spark):
    from tidemark.functions import recurrences as r

    x = [None, 1.0, 2.0, None, None, 5.0, 4.0, None, 1.0]
    df = spark.createDataFrame([("A", DAY + dt.timedelta(i), v) for i, v in enumerate(x)], "instrument string, session date, v double")
    got = [row.s for row in r.smooth(df, ["v"], {"s": lambda p: p.v.ewm(alpha=0.3, adjust=False).mean()}, []).orderBy("session").collect()]
    close_to([math.nan if v is None else v for v in got], pd.Series(x, dtype=float).ewm(alpha=0.3, adjust=False).mean())


def test_flat_and_rising_prices(spark):
    flat = pandas_of(indicators.averages(indicators.smoothed(random_bars(spark, 60, flat=True))))
    assert flat.rsi14.isna().all() and flat.adx14.isna().all() and (flat.bb_perc.dropna() == 0).all()
    up = frame(spark, [(i, i + 1, i - 1, i, 5) for i in range(10, 60)])
    assert (pandas_of(indicators.smoothed(up)).rsi14.dropna() == 100).all()


def test_full_windows_need_all_values(spark):
    rows = [(10, 11, 9, 10 + i, 5) for i in range(8)]
    rows[3] = (10, 11, 9, None, 5)
    got = [r.ma5 for r in indicators.averages(frame(spark, rows).withColumn("change_pct", F.lit(0.0))).orderBy("session").collect()]
    assert got[:7] == [None] * 7 or got[:8] == [None] * 8


def gate_bars(spark, last=3.3, drop=-3.0, ma5=1.0, hole=None):
    rows = [("A", DAY + dt.timedelta(i), -3.0 if i == 2 else 0.0, ma5, 2.0) for i in range(7)]
    rows[2] = ("A", rows[2][1], drop, ma5, 2.0)
    if hole is not None:
        rows[hole] = ("A", rows[hole][1], None, ma5, 2.0)
    rows.append(("A", DAY + dt.timedelta(7), last, ma5, 2.0))
    return spark.createDataFrame(rows, "instrument string, session date, change_pct double, ma5 double, ma20 double")


@pytest.mark.parametrize("change, fires", [({}, True), ({"last": 3.29}, False), ({"drop": -2.99}, False), ({"ma5": 2.0}, False), ({"hole": 5}, False)])
def test_rebound_gate(spark, change, fires):
    got = gate_bars(spark, **change).withColumn("g", signals.any_drop()).orderBy(F.desc("session")).first()
    assert got.g is fires


def test_relations_and_classes(spark):
    def label(highs, lows, closes=None):
        closes = closes or [100] * len(highs)
        rows = [(100, 100, 100, 100, 1)] + [(100, h, lo, x, 1) for h, lo, x in zip(highs, lows, closes, strict=True)]
        df = signals.labels(signals.forward_rates(frame(spark, rows)))
        return df.withColumn("ret", signals.trade_return()).orderBy("session").first()

    quiet = [100] * 7
    cases = {"target_before_stop_10": ([100, 110, *quiet[2:]], [100, 99, 94, *quiet[3:]]), "stop_before_target_10": ([100, 100, 110, *quiet[3:]], [94, *quiet[1:]]), "target_stop_same_day_10": ([100, 111, *quiet[2:]], [100, 93, *quiet[2:]]), "no_target_no_stop_10": (quiet, quiet)}
    rets = {"target_before_stop_10": 10, "stop_before_target_10": -6, "target_stop_same_day_10": -6, "no_target_no_stop_10": 2}
    for name, (highs, lows) in cases.items():
        r = label(highs, lows, [100] * 6 + [102])
        assert [x for x in cases if r[x]] == [name] and r.ret == pytest.approx(rets[name])
    for best, k in ((104.9, 0), (105, 1), (110, 2), (115, 3)):
        assert label([best, *quiet[1:]], quiet).target_class == k
    few = label([106], [99])  # one day ahead: the rest is null, not a miss
    assert (few.day_to_5, few.day_to_10, few.target_class) == (1, 0, 1)


def test_weeks_end_on_fridays(spark):
    fri = dt.date(2024, 1, 5)
    got = [r.w for r in spark.createDataFrame([(fri + dt.timedelta(i),) for i in range(4)], "d date").select(c.week_of("d").alias("w")).collect()]
    assert got == [fri] + [fri + dt.timedelta(7)] * 3
    few = resample.weekly_changes(frame(spark, [(1, 1, 1, 1 + i, 1) for i in range(3)])).collect()
    assert all(r.pct_vs_last4week is None for r in few)


def test_features_never_look_ahead(spark):
    bars = random_bars(spark, 160, 3)
    cut = bars.where(F.col("session") < DAY + dt.timedelta(120))
    every = lambda b: signals.signal_table(b, gate=F.lit(True), whole_future=False).select("session", *signals.FEATURES)
    a = {r.session: r for r in every(cut).collect()}
    b = {r.session: r for r in every(bars).collect()}
    assert len(a) == 51 and all(b[k] == v for k, v in a.items())


def test_upsert_takes_the_last_delivery(spark):
    mk = lambda rows: spark.createDataFrame(rows, "instrument string, session date, close double, delivered_at int")
    got = cleaning.upsert(mk([("A", DAY, 1.0, 0)]), mk([("A", DAY, 2.0, 1), ("A", DAY, 3.0, 2), ("B", DAY, 4.0, 1)]))
    assert sorted((r.instrument, r.close) for r in got.collect()) == [("A", 3.0), ("B", 4.0)]


def test_columns(spark):
    row = spark.range(1).select(
        c.number(F.lit("x")).alias("a"), c.number(F.lit("NaN")).alias("b"), c.number(F.lit("1.5")).alias("c"), c.rate(F.lit(110.0), F.lit(100.0)).alias("d"), c.rate(F.lit(1.0), F.lit(0.0)).alias("e"), c.code(F.lit(42)).alias("f"),
        c.rounded(F.lit(-0.0001), 3).alias("g"), c.short_number(F.lit(1234567)).alias("h"), c.display_width(F.lit("삼성A")).alias("i"), c.day_of(F.lit("Fri, 05 Jan 2024 00:00:00 GMT")).alias("j"), c.day_of(F.lit("soon")).alias("k"), c.clip(F.lit(12.0), -6.0, 10.0).alias("l"),
    ).first()
    assert (row.a, row.b, row.c, row.e, row.f, row.h, row.i, row.j, row.k, row.l) == (None, None, 1.5, None, "000042", "1.2M", 5, dt.date(2024, 1, 5), None, 10.0)
    assert row.d == pytest.approx(10) and str(row.g) == "0.0"


def test_files(spark, tmp_path):
    bars = random_bars(spark, 5)
    tables.write_bars(bars, str(tmp_path / "bars"))
    assert tables.read_bars(spark, str(tmp_path / "bars")).count() == 5
    tables.write_csv(bars.select("session", "instrument", "close"), str(tmp_path / "csv"), ["session"], byte_order_mark=True)
    back = tables.read_bars_csv(spark, str(tmp_path / "csv"))
    assert back.count() == 5 and back.where("session is null or close is null").count() == 0
    tables.write_by_day(bars, str(tmp_path / "days"))
    assert (tmp_path / "days" / "y=2024" / "m=01" / "d=01").exists()
    (tmp_path / "000001.json").write_text('{"bars": [{"session": "2024-01-02", "close": 5, "volume": 1}, {"session": null}]}')
    spark.dataSource.register(quotes.QuoteSource)
    got = spark.read.format("tidemark_quotes").option("base", str(tmp_path)).option("symbols", "000001").load()
    assert tables.normalised(got).select("instrument", "close").collect()[0] == ("000001", 5.0)

"""Technical indicators over an instrument's bars."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import recurrences as r
from tidemark.functions import windows as w
from tidemark.functions.columns import finite, ratio

EPS = 1e-9


def daily_change(bars: DataFrame, fill: bool = True) -> DataFrame:
    """change_pct: percent against the close before; 0 where there is none, or null."""
    prev = w.lag("close")
    change = (ratio(F.col("close"), prev) - 1) * 100
    return bars.withColumn("change_pct", F.coalesce(finite(change), F.lit(0.0)) if fill else finite(change))


def averages(bars: DataFrame) -> DataFrame:
    """ma5, ma10, ma20, std20, the bands at two deviations, and where the close stands in them."""
    df = bars.withColumns({f"ma{n}": w.mean("close", n) for n in (5, 10, 20)} | {"std20": w.std("close", 20)})
    df = df.withColumns({"upper_band": F.col("ma20") + 2 * F.col("std20"), "lower_band": F.col("ma20") - 2 * F.col("std20")})
    return df.withColumn("bb_perc", (F.col("close") - F.col("lower_band")) / (F.col("upper_band") - F.col("lower_band") + EPS))


def true_range(bars: DataFrame) -> DataFrame:
    prev = w.lag("close")
    return bars.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))


def cci(bars: DataFrame, n: int = 14) -> DataFrame:
    """The mean deviation is a rolling mean of each day's distance from its own average."""
    df = bars.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    df = df.withColumn("_off", F.col("_tp") - w.mean("_tp", n)).withColumn("_abs", F.abs("_off"))
    return df.withColumn(f"cci{n}", ratio(F.col("_off"), 0.015 * w.mean("_abs", n))).drop("_tp", "_off", "_abs")


def ultimate(bars: DataFrame, spans: tuple[int, int, int] = (7, 14, 28)) -> DataFrame:
    prev = w.lag("close")
    low, high = F.least(F.col("low"), prev), F.greatest(F.col("high"), prev)
    df = bars.withColumn("_bp", F.col("close") - low).withColumn("_tr", high - low)
    a, b, c = (ratio(w.total("_bp", n), w.total("_tr", n)) for n in spans)
    return df.withColumn("ultimate_osc", 100 * (4 * a + 2 * b + c) / 7).drop("_bp", "_tr")


def roc(bars: DataFrame, n: int = 12, pct: bool = True) -> DataFrame:
    old = w.lag("close", n)
    return bars.withColumn(f"roc{n}", (ratio("close", old) - 1) * 100 if pct else F.col("close") - old)


def volume_rank(bars: DataFrame, n: int = 20) -> DataFrame:
    """Share of the last n volumes that are no larger than today's."""
    held = F.collect_list("volume").over(w.last(n))
    share = F.size(F.filter(held, lambda v: v <= F.col("volume"))) / F.lit(float(n))
    return bars.withColumn("volume_rank", F.when(F.count("volume").over(w.last(n)) == n, share))


def volume_log_change(bars: DataFrame) -> DataFrame:
    log = F.ln(F.when(F.col("volume") > 0, F.col("volume")))
    df = bars.withColumn("_log", log)
    return df.withColumn("vol_logdiff", F.col("_log") - w.lag("_log")).drop("_log")


def historical_volatility(bars: DataFrame, n: int = 30, days: int = 365) -> DataFrame:
    """Annualised deviation of log returns."""
    df = log_returns(bars)
    return df.withColumn("hist_vol", w.std("log_return", n) * math.sqrt(days))


def log_returns(bars: DataFrame) -> DataFrame:
    return bars.withColumn("log_return", F.ln(F.when(F.col("close") > 0, F.col("close"))) - F.ln(F.when(w.lag("close") > 0, w.lag("close"))))


def rebuilt(bars: DataFrame) -> DataFrame:
    """The close rebuilt from the first one and the running sum of log returns."""
    df = log_returns(bars)
    first = F.first("close").over(w.so_far())
    return df.withColumn("rebuilt", first * F.exp(F.coalesce(F.sum("log_return").over(w.so_far()), F.lit(0.0))))


def smoothed(bars: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """MACD, RSI, ATR, +DI, -DI and ADX, all in one pass over each instrument."""
    keep = keep if keep is not None else [c for c in bars.columns if c not in ("instrument", "session")]
    df = true_range(bars)
    delta, up, down = F.col("close") - w.lag("close"), F.col("high") - w.lag("high"), w.lag("low") - F.col("low")
    df = df.withColumns({"_gain": F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0))), "_loss": F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0.0))), "_up": up, "_down": down})
    df = df.withColumns({"_pdm": F.when((F.col("_up") > F.col("_down")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0), "_mdm": F.when((F.col("_down") > F.col("_up")) & (F.col("_down") > 0), F.col("_down")).otherwise(0.0)})
    over = lambda a, b: a / b.where(b != 0)  # noqa: E731  nothing over 0 is no value
    series = {
        "ema12": lambda p: r.ema(p.close, 12),
        "ema26": lambda p: r.ema(p.close, 26),
        "macd": lambda p: p.ema12 - p.ema26,
        "macd_signal": lambda p: r.ema(p.macd, 9),
        "_ga": lambda p: r.wilder(p._gain, 14),
        "_lo": lambda p: r.wilder(p._loss, 14),
        "atr14": lambda p: r.wilder(p.tr, 14),
        "plus_di": lambda p: 100 * over(r.wilder(p._pdm, 14), p.atr14),
        "minus_di": lambda p: 100 * over(r.wilder(p._mdm, 14), p.atr14),
        "adx14": lambda p: r.wilder(100 * over((p.plus_di - p.minus_di).abs(), p.plus_di + p.minus_di), 14),
    }
    out = r.smooth(df, ["close", "tr", "_gain", "_loss", "_pdm", "_mdm"], series, keep)
    rsi = F.when((F.col("_lo") == 0) & (F.col("_ga") > 0), 100.0).when(F.col("_lo") > 0, 100 - 100 / (1 + F.col("_ga") / F.when(F.col("_lo") > 0, F.col("_lo"))))
    return out.withColumns({"rsi14": rsi, "macd_hist": F.col("macd") - F.col("macd_signal")}).drop("_ga", "_lo")


def technical(bars: DataFrame) -> DataFrame:
    """All indicators of a bar table."""
    df = averages(daily_change(bars))
    df = volume_log_change(ultimate(cci(df)))
    return smoothed(df)

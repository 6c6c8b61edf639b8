"""Gates, point-in-time features and forward labels.

Features look back only and labels ahead only; both come from frames over the same
ordering, so the whole signal table is one shuffle and one sort by instrument.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import windows as w
from tidemark.functions.columns import clip, finite, rate, rounded
from tidemark.operators import indicators, resample

EPS = 1e-9


@dataclass(frozen=True)
class Levels:
    """Targets and the stop in percent, and how many sessions are watched."""

    targets: tuple[int, int, int] = (5, 10, 15)
    target_pct: float = 10.0
    stop_loss: float = -6.0
    days: int = 7
    fast_days: int = 4


V2 = Levels()
V1 = Levels((4, 7, 12), 7.0)

FEATURES = (
    "vol5", "rebound_from_7d_low", "dist_to_ma5", "tr_value_ratio_5d", "max_drop_7d", "bb_perc", "gap_pct", "upper_wick_ratio", "lower_wick_ratio", "room_to_60d_high",
    "vol15", "ma5_chg_rate", "pct_vs_lastweek", "dist_to_ma20", "atr_pct", "vol_ratio_5_15", "intraday_return", "body_ratio", "today_tr_val_eok", "room_to_20d_high", "rebound_vs_prior_drop",
)


def any_drop(days: int = 7, up: float = 3.3, down: float = -3.0) -> Column:
    """Today rises by ``up`` or more after days of ma5 below ma20, one of them with a drop to ``down``."""
    past = w.before(days)
    whole = F.count(F.when(F.col("change_pct").isNotNull() & F.col("ma5").isNotNull() & F.col("ma20").isNotNull(), 1)).over(past) == days
    under = F.min((F.col("ma5") < F.col("ma20")).cast("int")).over(past) == 1
    return F.coalesce((F.col("change_pct") >= up) & (F.min("change_pct").over(past) <= down) & under & whole, F.lit(False))


def swing_rebound(ma_days: int = 10, up: float = 1.8, down: float = -2.5, ret_days: int = 10, ret: float = -7.0, low_days: int = 60, band: float = 0.03, hold: int = 3, above_ma5: bool = True, volume: float | None = None, volume_days: int = 20) -> Column:
    """Oversold, near the low of ``low_days`` without closing below it, and turning up."""
    usable = F.col("change_pct").isNotNull() & F.col("ma5").isNotNull() & F.col("ma20").isNotNull() & F.col("close").isNotNull()
    need = max(ma_days, ret_days, low_days, hold)
    whole = (F.count(F.when(usable, 1)).over(w.before(need)) == need) & usable
    past = w.before(ma_days)
    under = F.min((F.col("ma5") < F.col("ma20")).cast("int")).over(past) == 1
    compound = F.aggregate(F.collect_list("change_pct").over(w.before(ret_days)), F.lit(1.0), lambda p, c: p * (1 + c / 100)) - 1
    low = F.min("close").over(w.before(low_days))
    gate = (F.col("change_pct") >= up) & (F.min("change_pct").over(past) <= down) & under & (compound * 100 <= ret) & (F.col("close") <= low * (1 + band)) & (F.min("close").over(w.before(hold)) >= low)
    if above_ma5:
        gate = gate & (F.col("close") >= F.col("ma5"))
    if volume is not None:
        gate = gate & (F.col("volume") >= F.avg("volume").over(w.before(volume_days)) * volume)
    return F.coalesce(gate & whole, F.lit(False))


def liquid(today: float = 4e8, mean: float = 3e8, days: int = 20) -> Column:
    """Turnover of today and mean turnover of the days before."""
    value = F.col("close") * F.col("volume")
    return F.coalesce((value >= today) & (F.avg(value).over(w.before(days)) >= mean), F.lit(False))


def seasoned(bars: int = 70) -> Column:
    """At least so many bars up to today."""
    return F.row_number().over(w.by()) >= bars


def turnover_surge(least_price: float = 700, least_change: float = 3.0, least_cap: float = 7e10, cap: Column | None = None, flat: float = 6.0, times: dict[str, float] | None = None, days: int = 10) -> Column:
    """Up, with a flat ten days or turnover of several times its five-day mean; rejected if neither.

    ``cap``: market capitalisation; an instrument without one is skipped.
    """
    times = times or {"even": 6.0, "odd": 5.0}
    value = F.col("close") * F.col("volume")
    past = w.before(days)
    spread = F.try_divide(F.max("close").over(past) - F.min("close").over(past), F.min("close").over(past)) * 100
    mult = F.coalesce(*[F.when(F.col("market") == m, F.lit(t)) for m, t in times.items()], F.lit(max(times.values())))
    surge = value >= mult * F.avg(value).over(w.before(5))
    calm = (spread < flat) & (F.count("close").over(past) == days)
    gate = (F.col("close") >= least_price) & (F.col("change_pct") >= least_change) & (F.coalesce(calm, F.lit(False)) | F.coalesce(surge, F.lit(False)))
    return F.coalesce(gate & (cap >= least_cap) if cap is not None else gate, F.lit(False))


def forecastable(least_price: float = 500, turnover: float = 2e9, fast: float = 2.0, slow: float = 1.6, slope: float = -3.0) -> Column:
    """Filters before a forecast: price, turnover, no doubling in 3 days, no 1.6-fold in 5, no steep fall."""
    value = F.col("close") * F.col("volume")
    gate = (F.col("close") >= least_price) & (F.avg(value).over(w.last(3)) > turnover)
    gate = gate & ~F.coalesce(F.col("close") >= fast * w.lag("close", 3), F.lit(False)) & ~F.coalesce(F.col("close") >= slow * w.lag("close", 5), F.lit(False))
    falling = (F.col("ma5") < F.col("ma20")) & (rate("ma5", w.lag("ma5")) < slope)
    return F.coalesce(gate & ~F.coalesce(falling, F.lit(False)), F.lit(False))


def features(df: DataFrame) -> DataFrame:
    """Adds FEATURES and a few more to bars with change_pct, averages and atr14."""
    value = F.col("close") * F.col("volume")
    df = resample.weekly_changes(df).withColumn("_value", F.round(value, 2))
    before5, spread = F.avg("_value").over(w.before(5)), F.col("high") - F.col("low") + EPS
    out = {
        "vol5": w.std("change_pct", 5),
        "vol15": w.std("change_pct", 15),
        "max_drop_7d": F.min("change_pct").over(w.before(7)),
        "rebound_from_7d_low": (F.try_divide(F.col("close"), F.min("low").over(w.before(7))) - 1) * 100,
        "dist_to_ma5": rate("close", "ma5"),
        "dist_to_ma20": rate("close", "ma20"),
        "ma5_chg_rate": rate("ma5", w.lag("ma5")),
        "tr_value_ratio_5d": F.when(before5 > 0, F.col("_value") / (before5 + EPS)).when(before5.isNotNull(), 0.0),
        "today_tr_val_eok": F.col("_value") / 1e8,
        "gap_pct": (F.try_divide(F.col("open"), w.lag("close")) - 1) * 100,
        "intraday_return": (F.try_divide(F.col("close"), F.col("open")) - 1) * 100,
        "upper_wick_ratio": (F.col("high") - F.greatest("open", "close")) / spread,
        "lower_wick_ratio": (F.least("open", "close") - F.col("low")) / spread,
        "body_ratio": F.abs(F.col("close") - F.col("open")) / spread,
        "room_to_20d_high": (F.try_divide(F.max("high").over(w.last(20)), F.col("close")) - 1) * 100,
        "room_to_60d_high": (F.try_divide(F.max("high").over(w.last(60)), F.col("close")) - 1) * 100,
        "today_pct": F.round("change_pct", 2),
    }
    if "atr14" in df.columns:
        out["atr_pct"] = F.try_divide(F.col("atr14"), F.col("close")) * 100
    df = df.withColumns(out)
    more = {
        "vol_ratio_5_15": F.round(F.col("vol5") / (F.col("vol15") + EPS), 3),
        "rebound_vs_prior_drop": F.col("rebound_from_7d_low") / (F.abs("max_drop_7d") + EPS),
        "price_power_value": F.col("today_pct") * F.log1p(F.greatest("today_tr_val_eok", F.lit(0.0))),
        "body_value_power": F.greatest("body_ratio", F.lit(0.0)) * F.greatest("today_pct", F.lit(0.0)) * F.log1p(F.greatest("today_tr_val_eok", F.lit(0.0))),
    }
    df = df.withColumns(more)
    names = [*out, *more]
    return df.withColumns({c: rounded(finite(c)) for c in names}).drop("_value")


def longer_features(df: DataFrame) -> DataFrame:
    """Monthly and quarterly views for markets without a price limit: deviation, mean and
    share of rises of 20 and 30 days, and range and drawdown of 60."""
    out = {}
    for n in (20, 30):
        out |= {f"vol{n}": w.std("change_pct", n), f"mean_ret{n}": w.mean("change_pct", n), f"pos{n}_ratio": w.full(lambda x: F.avg((x > 0).cast("double")), "change_pct", n)}
    top, bottom = w.full(F.max, "high", 60), w.full(F.min, "low", 60)
    out |= {"range_3m": (F.try_divide(top, bottom) - 1) * 100, "drawdown_3m": (F.try_divide(F.col("close"), top) - 1) * 100}
    return df.withColumns({k: finite(v) for k, v in out.items()})


def forward_rates(df: DataFrame, days: int = 7) -> DataFrame:
    """Arrays of the next days' close, high, low and open against today's close; a missing day is null."""
    lists = {f"{c}_rates": F.array(*[rate(w.lead(c, k), "close") for k in range(1, days + 1)]) for c in ("close", "high", "low", "open")}
    return df.withColumns(lists)


def first_day(rates: str, level: float, up: bool = True) -> Column:
    """The first day at or beyond a level; 0 if there is none."""
    hit = F.transform(rates, lambda r: F.coalesce(r >= level if up else r <= level, F.lit(False)))
    return F.coalesce(F.array_position(hit, True), F.lit(0)).cast("int")


def labels(df: DataFrame, levels: Levels = V2) -> DataFrame:
    """First-touch days, their relation to the stop, speed flags, class and forward extremes."""
    low, mid, high = levels.targets
    df = df.withColumns({f"day_to_{t}": first_day("high_rates", t) for t in levels.targets} | {"stop_day": first_day("low_rates", levels.stop_loss, False)})
    out = {}
    for t in (mid, high):
        day, stop = F.col(f"day_to_{t}"), F.col("stop_day")
        won = (day > 0) & ((stop == 0) | (day < stop))
        out |= {
            f"target_before_stop_{t}": won,
            f"stop_before_target_{t}": (stop > 0) & ((day == 0) | (stop < day)),
            f"target_stop_same_day_{t}": (day > 0) & (day == stop),
            f"no_target_no_stop_{t}": (day == 0) & (stop == 0),
            f"fast_success_{t}": won & (day <= levels.fast_days),
            f"slow_success_{t}": won & (day > levels.fast_days) & (day <= 7),
            f"fail_success_{t}": ~won,
        }
    best = F.array_max("high_rates")
    out |= {
        "stop_loss": F.lit(levels.stop_loss),
        "target_pct": F.lit(levels.target_pct),
        "validation_high_rate_max": rounded(best),
        "validation_low_rate_min": rounded(F.array_min("low_rates")),
        "validation_close_rate7": rounded(F.element_at("close_rates", levels.days)),
        "target_class": F.when(best < low, 0).when(best < mid, 1).when(best < high, 2).when(best.isNotNull(), 3),
    }
    return df.withColumns(out)


def spread_rates(df: DataFrame, days: int = 7) -> DataFrame:
    """The forward arrays as columns validation_<price>_rate<k>."""
    return df.withColumns({f"validation_{c}_rate{k}": rounded(F.get(f"{c}_rates", F.lit(k - 1))) for c in ("close", "high", "low", "open") for k in range(1, days + 1)}).drop(*[f"{c}_rates" for c in ("close", "high", "low", "open")])


def signal_table(bars: DataFrame, levels: Levels = V2, least_bars: int = 70, gate: Column | None = None, smooth: bool = True, whole_future: bool = True) -> DataFrame:
    """One row for each instrument and day that passes the gate, with features and labels."""
    df = indicators.averages(indicators.daily_change(bars))
    if smooth:
        df = indicators.smoothed(df)
    df = labels(forward_rates(features(df), levels.days), levels)
    ahead = F.count("close").over(w.ahead(levels.days))
    keep = seasoned(least_bars) & (any_drop() if gate is None else gate) & ((ahead == levels.days) if whole_future else F.lit(True))
    df = df.withColumn("_keep", keep).withColumn("idx", F.row_number().over(w.by())).where("_keep").drop("_keep")
    return df.withColumn("today", F.col("session")).withColumn("month", F.date_format("session", "yyyy-MM"))


def trade_return(target: str = "target_before_stop_10", levels: Levels = V2, same_day: float = -6.0) -> Column:
    """Return of a signal; of the flags a later one wins: target, stop, same day, neither."""
    t = target.rsplit("_", 1)[1]
    last_close = F.coalesce(F.col("validation_close_rate7"), F.lit(0.0))
    return (
        F.when(F.col(f"no_target_no_stop_{t}"), clip(last_close, min(levels.stop_loss, levels.target_pct), max(levels.stop_loss, levels.target_pct)))
        .when(F.col(f"target_stop_same_day_{t}"), same_day)
        .when(F.col(f"stop_before_target_{t}"), levels.stop_loss)
        .when(F.col(target), levels.target_pct)
        .otherwise(0.0)
    )

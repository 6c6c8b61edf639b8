"""Queries over bars: aggregation, cleaning, indicators, breadth, gates, features, labels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as c
from tidemark.functions import windows as w
from tidemark.operators import cleaning, indicators, resample, signals
from tidemark.plans import sql
from tidemark.sources import tables

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text:
            ORACLE_SQL[name] = text
        return f

    return add


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.bars_from_lineitem(spark, sf_dir)


def rounded(df: DataFrame, keys: list[str], values: list[str], digits: int = 8) -> DataFrame:
    return df.select(*keys, *[c.rounded(c.finite(v), digits).alias(v) for v in values])


def sql_rounded(source: str, keys: list[str], values: list[str], ctes: list[str], digits: int = 8) -> str:
    return f"WITH {','.join(ctes)} SELECT {', '.join(keys)}, {', '.join(f'{sql.rnd(v, digits)} AS {v.split(chr(32))[-1]}' for v in values)} FROM {source}"


KEY = ["instrument", "session"]


@query("bars_daily", sql_rounded("bars", [*KEY, "market"], ["open", "high", "low", "close", "volume"], [sql.BARS]))
def bars_daily(spark, sf_dir):
    return rounded(bars(spark, sf_dir), [*KEY, "market"], ["open", "high", "low", "close", "volume"])


def _resampled(period: str, name: str) -> str:
    return f"""WITH {sql.BARS} SELECT instrument, {period} AS {name}, round(arg_min(open, session), 8) AS open, round(max(high), 8) AS high, round(min(low), 8) AS low,
        round(arg_max(close, session), 8) AS close, round(sum(volume), 8) AS volume, count(*) AS sessions FROM bars GROUP BY 1, 2"""


@query("bars_weekly", _resampled(sql.WEEK, "week"))
def bars_weekly(spark, sf_dir):
    return rounded(resample.weekly(bars(spark, sf_dir)), ["instrument", "week", "sessions"], ["open", "high", "low", "close", "volume"])


@query("bars_monthly", _resampled("strftime(session, '%Y-%m')", "month"))
def bars_monthly(spark, sf_dir):
    return rounded(resample.monthly(bars(spark, sf_dir)), ["instrument", "month", "sessions"], ["open", "high", "low", "close", "volume"])


_HALTED = """
broken AS (
  SELECT instrument, session, market, CASE WHEN hit THEN 0 ELSE open END AS open, CASE WHEN hit THEN 0 ELSE high END AS high, CASE WHEN hit THEN 0 ELSE low END AS low,
         CASE WHEN hit AND volume % 2 = 0 THEN NULL ELSE close END AS close, CASE WHEN hit THEN 0 ELSE volume END AS volume
  FROM (SELECT *, volume % 7 = 0 AS hit FROM bars)
)"""


def halted(spark, sf_dir) -> DataFrame:
    """Bars in which every seventh volume is made a halt day."""
    hit = F.pmod("volume", F.lit(7)) == 0
    df = bars(spark, sf_dir)
    gone = {p: F.when(hit, F.lit(0.0)).otherwise(F.col(p)) for p in ("open", "high", "low", "volume")}
    return df.withColumns(gone | {"close": F.when(hit & (F.pmod("volume", F.lit(2)) == 0), F.lit(None)).otherwise(F.col("close"))})


@query(
    "halt_repair",
    f"""WITH {sql.BARS},{_HALTED},
    prior AS (SELECT *, lag(close) OVER ({sql.W}) AS pc, coalesce(volume, 0) <= 0 AS halt FROM broken),
    fixed AS (SELECT instrument, session, market, CASE WHEN halt THEN pc ELSE open END AS open, CASE WHEN halt THEN pc ELSE high END AS high,
                     CASE WHEN halt AND (low IS NULL OR low <= 0 OR low > pc) THEN pc ELSE low END AS low, CASE WHEN halt THEN pc ELSE close END AS close, volume FROM prior)
    SELECT instrument, session, market, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, round(volume, 8) AS volume
    FROM fixed WHERE open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume IS NOT NULL AND high >= low""",
)
def halt_repair(spark, sf_dir):
    return rounded(cleaning.drop_halts(halted(spark, sf_dir)), [*KEY, "market"], ["open", "high", "low", "close", "volume"])


@query(
    "sparse_profile",
    f"""WITH {sql.BARS},{_HALTED},
    shares AS (SELECT instrument, c, avg(CAST(v IS NULL AS INT)) AS null_share FROM (SELECT instrument, unnest(['close', 'volume']) AS c, unnest([close, volume]) AS v FROM broken) GROUP BY 1, 2)
    SELECT instrument, c AS "column", round(null_share, 6) AS null_share, 0.0 AS inf_share, null_share <= 0.1 AS usable FROM shares""",
)
def sparse_profile(spark, sf_dir):
    return rounded(cleaning.sparse_profile(halted(spark, sf_dir), ["close", "volume"]), ["instrument", "column", "usable"], ["null_share", "inf_share"], 6)


@query(
    "bars_upsert",
    f"""WITH {sql.BARS} SELECT instrument, session, round(CASE WHEN volume % 3 = 0 THEN close * 2 ELSE close END, 8) AS close, round(volume, 8) AS volume FROM bars
    UNION ALL SELECT instrument, CAST(max(session) + INTERVAL 1 DAY AS DATE), round(arg_max(close, session), 8), 1.0 FROM bars GROUP BY instrument""",
)
def bars_upsert(spark, sf_dir):
    """Corrections of a third of the bars, delivered twice, and one new session each."""
    b = bars(spark, sf_dir).select(*KEY, "close", "volume")
    fixed = b.where("volume % 3 = 0")
    new = b.groupBy("instrument").agg(F.date_add(F.max("session"), 1).alias("session"), F.max_by("close", "session").alias("close"), F.lit(1.0).alias("volume"))
    late = fixed.withColumn("close", F.col("close") * 2).withColumn("delivered_at", F.lit(2))
    early = fixed.withColumn("close", F.lit(1.0)).withColumn("delivered_at", F.lit(1))
    delivered = late.unionByName(early).unionByName(new.withColumn("delivered_at", F.lit(1)))
    return rounded(cleaning.upsert(b.withColumn("delivered_at", F.lit(0)), delivered), KEY, ["close", "volume"])


def _simple(name: str, build, values: list[str], ctes: list[str], source: str, exprs: list[str] | None = None, digits: int = 8):
    """Register a query that adds value columns to bars."""
    text = f"WITH {','.join(ctes)} SELECT instrument, session, {', '.join(f'{sql.rnd(e, digits)} AS {v}' for v, e in zip(values, exprs or values, strict=True))} FROM {source}"
    query(name, text)(lambda spark, sf_dir: rounded(build(bars(spark, sf_dir)), KEY, values, digits))


_simple("daily_change", indicators.daily_change, ["change_pct"], [sql.BARS, sql.CHANGE], "changed", digits=6)
_simple("sma_bands", lambda b: indicators.averages(indicators.daily_change(b)), ["ma5", "ma10", "ma20", "std20", "upper_band", "lower_band", "bb_perc"], [sql.BARS, sql.CHANGE, sql.AVERAGES], "averaged", digits=4)
_simple("rolling_vol", lambda b: indicators.daily_change(b).withColumns({"vol5": w.std("change_pct", 5), "vol15": w.std("change_pct", 15)}), ["vol5", "vol15"], [sql.BARS, sql.CHANGE], "changed", [sql.full("stddev_samp", "change_pct", 5), sql.full("stddev_samp", "change_pct", 15)], 4)
_simple("rate_of_change", indicators.roc, ["roc12"], [sql.BARS], "bars", [f"(close / nullif(lag(close, 12) OVER ({sql.W}), 0) - 1) * 100"], 6)
_simple("true_range", indicators.true_range, ["tr"], [sql.BARS, sql.CHANGE, sql.TRUE_RANGE], "ranged")
_simple(
    "cci",
    indicators.cci,
    ["cci14"],
    [sql.BARS, "typical AS (SELECT *, (high + low + close) / 3 AS tp FROM bars)", f"off AS (SELECT *, tp - {sql.full('avg', 'tp', 14)} AS d FROM typical)", "dist AS (SELECT *, abs(d) AS ad FROM off)"],
    "dist",
    [f"d / nullif(0.015 * {sql.full('avg', 'ad', 14)}, 0)"],
    4,
)
_UO = lambda n: f"({sql.full('sum', 'bp', n)}) / nullif({sql.full('sum', 'tr', n)}, 0)"
_simple(
    "ultimate_osc",
    indicators.ultimate,
    ["ultimate_osc"],
    [sql.BARS, sql.CHANGE, "pressed AS (SELECT *, close - least(low, prev_close) AS bp, greatest(high, prev_close) - least(low, prev_close) AS tr FROM changed)"],
    "pressed",
    [f"100 * (4 * {_UO(7)} + 2 * {_UO(14)} + {_UO(28)}) / 7"],
    4,
)
_simple(
    "volume_rank",
    indicators.volume_rank,
    ["volume_rank"],
    [sql.BARS, f"held AS (SELECT *, list(volume) OVER {sql.last(20)} AS vs FROM bars)"],
    "held",
    ["CASE WHEN len(vs) = 20 THEN len(list_filter(vs, lambda v: v <= volume)) / 20.0 END"],
)
_simple("volume_log_change", indicators.volume_log_change, ["vol_logdiff"], [sql.BARS], "bars", [f"ln(nullif(volume, 0)) - lag(ln(nullif(volume, 0))) OVER ({sql.W})"], 6)
_simple("hist_volatility", indicators.historical_volatility, ["hist_vol"], [sql.BARS, f"logs AS (SELECT *, ln(close) - lag(ln(close)) OVER ({sql.W}) AS lr FROM bars)"], "logs", [f"({sql.full('stddev_samp', 'lr', 30)}) * {math.sqrt(365)!r}"], 6)
_simple(
    "log_return_rebuild",
    lambda b: indicators.rebuilt(b).withColumn("ln_rebuilt", F.ln("rebuilt")),
    ["log_return", "ln_rebuilt"],
    [sql.BARS, f"logs AS (SELECT *, ln(close) - lag(ln(close)) OVER ({sql.W}) AS lr FROM bars)"],
    "logs",
    ["lr", f"ln(first_value(close) OVER ({sql.W}) * exp(coalesce(sum(lr) OVER ({sql.W} ROWS UNBOUNDED PRECEDING), 0)))"],
    6,
)


def smoothed(b):
    return indicators.smoothed(b, ["close", "high", "low"])


_EMA = [sql.BARS, f"emas AS (SELECT *, {sql.fold('close', 2 / 13)} AS ema12, {sql.fold('close', 2 / 27)} AS ema26 FROM bars)", "macds AS (SELECT *, ema12 - ema26 AS macd FROM emas)", f"signed AS (SELECT *, {sql.fold('macd', 0.2)} AS macd_signal FROM macds)"]
_simple("ema_macd", smoothed, ["ema12", "ema26", "macd", "macd_signal", "macd_hist"], _EMA, "signed", ["ema12", "ema26", "macd", "macd_signal", "macd - macd_signal"], 4)
_GAINS = [sql.BARS, sql.CHANGE, "moves AS (SELECT *, greatest(close - prev_close, 0) + (prev_close - prev_close) AS gain, greatest(prev_close - close, 0) + (prev_close - prev_close) AS loss FROM changed)", f"rsis AS (SELECT *, {sql.fold('gain', 1 / 14)} AS g, {sql.fold('loss', 1 / 14)} AS l FROM moves)"]
_simple("rsi", smoothed, ["rsi14"], _GAINS, "rsis", ["CASE WHEN l = 0 AND g > 0 THEN 100 WHEN l > 0 THEN 100 - 100 / (1 + g / l) END"], 4)
_simple("atr", smoothed, ["atr14"], [sql.BARS, sql.CHANGE, sql.TRUE_RANGE, f"atrs AS (SELECT *, {sql.fold('tr', 1 / 14)} AS atr14 FROM ranged)"], "atrs", ["atr14"], 4)
_DI = [
    sql.BARS,
    sql.CHANGE,
    sql.TRUE_RANGE,
    f"steps AS (SELECT *, high - lag(high) OVER ({sql.W}) AS up, lag(low) OVER ({sql.W}) - low AS down FROM ranged)",
    "dms AS (SELECT *, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS mdm FROM steps)",
    f"dis AS (SELECT *, {sql.fold('pdm', 1 / 14)} AS sp, {sql.fold('mdm', 1 / 14)} AS sm, {sql.fold('tr', 1 / 14)} AS atr14 FROM dms)",
]
_simple("directional", smoothed, ["plus_di", "minus_di"], _DI, "dis", ["100 * sp / nullif(atr14, 0)", "100 * sm / nullif(atr14, 0)"], 4)


_DX = [*_DI, "dxs AS (SELECT *, 100 * abs(sp - sm) / nullif(sp + sm, 0) AS dx FROM dis)", f"adxs AS (SELECT *, {sql.gap_fold('dx', 1 / 14)} AS adx14 FROM dxs)"]
_simple("adx", smoothed, ["adx14"], _DX, "adxs", digits=4)


_BREADTH = f"""
five AS (SELECT *, (close / nullif(lag(close, 5) OVER ({sql.W}), 0) - 1) * 100 AS f FROM changed),
breadth AS (SELECT session, market, avg(change_pct) AS market_today_pct, avg(f) AS market_5d_pct, avg(CAST(change_pct > 0 AS INT)) AS market_breadth_up_ratio, count(*) AS market_stock_count FROM five GROUP BY 1, 2)"""
_CONTEXT = ["market_today_pct", "market_5d_pct", "market_breadth_up_ratio"]


@query("market_breadth", sql_rounded("breadth", ["session", "market", "market_stock_count"], _CONTEXT, [sql.BARS, sql.CHANGE, _BREADTH], 6))
def market_breadth(spark, sf_dir):
    return rounded(resample.breadth(indicators.daily_change(bars(spark, sf_dir))), ["session", "market", "market_stock_count"], _CONTEXT, 6)


@query(
    "market_context",
    f"""WITH {sql.BARS},{sql.CHANGE},{_BREADTH} SELECT a.instrument, a.session, round(m.market_today_pct, 6) AS market_today_pct, coalesce(m.market_stock_count, 0) AS market_stock_count
    FROM changed a LEFT JOIN (SELECT * FROM breadth WHERE market = 'even') m ON a.session = m.session AND a.market = m.market""",
)
def market_context(spark, sf_dir):
    b = indicators.daily_change(bars(spark, sf_dir))
    return rounded(resample.with_context(b, resample.breadth(b).where("market = 'even'")), [*KEY, "market_stock_count"], ["market_today_pct"], 6)


@query("instrument_lookup", f"WITH {sql.BARS} SELECT instrument, max(market) AS stock_market, 'stock ' || instrument AS stock_name, count(*) AS n FROM bars GROUP BY instrument UNION ALL SELECT '000042', NULL, 'Unknown Stock', 1")
def instrument_lookup(spark, sf_dir):
    """Dimension lookup with a default for codes that the dimension lacks."""
    b = bars(spark, sf_dir)
    known = b.groupBy("instrument").agg(F.count(F.lit(1)).alias("n"))
    asked = known.unionByName(spark.createDataFrame([("42", 1)], "instrument string, n long").withColumn("instrument", c.code("instrument")))
    out = asked.join(tables.instruments(b), "instrument", "left")
    return out.select("instrument", "stock_market", F.coalesce("stock_name", F.lit("Unknown Stock")).alias("stock_name"), "n")


@query("asof_prev_close", sql_rounded("found", KEY, ["asof_close"], [sql.BARS, _HALTED, f"found AS (SELECT *, last_value(close IGNORE NULLS) OVER ({sql.W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asof_close FROM broken)"]))
def asof_prev_close(spark, sf_dir):
    return rounded(resample.previous_close(halted(spark, sf_dir)), KEY, ["asof_close"])


@query(
    "asof_join",
    f"""WITH {sql.BARS} SELECT a.instrument, a.session, round((SELECT arg_max(b.close, b.session) FROM bars b WHERE b.instrument = a.instrument AND b.session < a.session AND b.volume % 5 = 0), 8) AS asof_value
    FROM bars a WHERE a.volume % 7 = 0""",
)
def asof_join(spark, sf_dir):
    b = bars(spark, sf_dir)
    return rounded(resample.asof(b.where("volume % 7 = 0"), b.where("volume % 5 = 0")), KEY, ["asof_value"])


@query("weekly_changes", f"WITH {sql.BARS},{sql.WEEKS} SELECT instrument, session, pct_vs_lastweek, pct_vs_last4week, is_drop_more_than_minus1pct FROM weekly_changes")
def weekly_changes(spark, sf_dir):
    return resample.weekly_changes(bars(spark, sf_dir)).select(*KEY, "pct_vs_lastweek", "pct_vs_last4week", "is_drop_more_than_minus1pct")


def averaged(spark, sf_dir):
    return indicators.averages(indicators.daily_change(bars(spark, sf_dir)))


@query("gate_any_drop", f"WITH {sql.BARS},{sql.CHANGE},{sql.AVERAGES},{sql.ANY_DROP} SELECT instrument, session FROM gated WHERE fires AND idx >= 70")
def gate_any_drop(spark, sf_dir):
    return averaged(spark, sf_dir).withColumn("fires", signals.any_drop() & signals.seasoned()).where("fires").select(*KEY)


@query(
    "gate_swing_rebound",
    f"""WITH {sql.BARS},{sql.CHANGE},{sql.AVERAGES},
    seen AS (SELECT *, coalesce(change_pct >= 1.8 AND min(change_pct) OVER {sql.before(3)} <= -2.5 AND min(CAST(ma5 < ma20 AS INT)) OVER {sql.before(3)} = 1
        AND (product(1 + change_pct / 100) OVER {sql.before(5)} - 1) * 100 <= -7.0 AND close <= min(close) OVER {sql.before(20)} * 3.0
        AND min(close) OVER {sql.before(3)} >= min(close) OVER {sql.before(20)} AND close >= ma5 AND ma20 IS NOT NULL
        AND count(ma20) OVER {sql.before(20)} = 20, false) AS fires FROM averaged)
    SELECT instrument, session FROM seen WHERE fires""",
)
def gate_swing_rebound(spark, sf_dir):
    """A wide band and short spans: unit prices swing far more than share prices."""
    return averaged(spark, sf_dir).withColumn("fires", signals.swing_rebound(ma_days=3, ret_days=5, low_days=20, band=2.0)).where("fires").select(*KEY)


@query(
    "turnover_surge",
    f"""WITH {sql.BARS},{sql.CHANGE},
    seen AS (SELECT *, coalesce(close >= 700 AND change_pct >= 3.0 AND
        (coalesce((max(close) OVER {sql.before(10)} - min(close) OVER {sql.before(10)}) / nullif(min(close) OVER {sql.before(10)}, 0) * 100 < 6.0 AND count(close) OVER {sql.before(10)} = 10, false)
         OR coalesce(close * volume >= CASE market WHEN 'even' THEN 6.0 ELSE 5.0 END * avg(close * volume) OVER {sql.before(5)}, false)), false) AS fires FROM changed)
    SELECT instrument, session FROM seen WHERE fires""",
)
def turnover_surge(spark, sf_dir):
    return indicators.daily_change(bars(spark, sf_dir)).withColumn("fires", signals.turnover_surge()).where("fires").select(*KEY)


@query(
    "forecast_prefilter",
    f"""WITH {sql.BARS},{sql.CHANGE},{sql.AVERAGES},
    seen AS (SELECT *, lag(ma5) OVER ({sql.W}) AS pma5, lag(close, 3) OVER ({sql.W}) AS c3, lag(close, 5) OVER ({sql.W}) AS c5, avg(close * volume) OVER {sql.last(3)} AS tv FROM averaged)
    SELECT instrument, session FROM seen WHERE close >= 500 AND tv > 10000 AND NOT coalesce(close >= 2.0 * c3, false) AND NOT coalesce(close >= 1.6 * c5, false)
      AND NOT coalesce(ma5 < ma20 AND (ma5 - pma5) / nullif(pma5, 0) * 100 < -3.0, false)""",
)
def forecast_prefilter(spark, sf_dir):
    return averaged(spark, sf_dir).withColumn("ok", signals.forecastable(turnover=1e4)).where("ok").select(*KEY)


@query("liquidity_gate", f"WITH {sql.BARS}, v AS (SELECT *, avg(close * volume) OVER {sql.before(20)} AS m FROM bars) SELECT instrument, session FROM v WHERE close * volume >= 40000 AND m >= 30000")
def liquidity_gate(spark, sf_dir):
    return bars(spark, sf_dir).withColumn("ok", signals.liquid(4e4, 3e4)).where("ok").select(*KEY)


def signal_rows(spark, sf_dir, smooth: bool = False) -> DataFrame:
    df = signals.signal_table(bars(spark, sf_dir), smooth=smooth)
    return df.withColumn("ret", signals.trade_return()).withColumn("bb", c.rounded("bb_perc"))


_SHOWN = [*sql.FEATURE_NAMES, "pct_vs_lastweek", "bb"]


@query("features_point_in_time", f"WITH {sql.SIGNALS} SELECT instrument, session, {', '.join(_SHOWN)} FROM signals")
def features_point_in_time(spark, sf_dir):
    return signal_rows(spark, sf_dir).select(*KEY, *_SHOWN)


_ALL = [f for f in signals.FEATURES if f not in ("atr_pct", "bb_perc")]


@query(
    "features_with_smoothing",
    f"""WITH {sql.SIGNALS},{sql.TRUE_RANGE}, atrs AS (SELECT instrument, session, close, {sql.fold('tr', 1 / 14)} AS atr14 FROM ranged)
    SELECT s.instrument, s.today, s.idx, {', '.join(f's.{f}' for f in _ALL)}, s.bb AS bb_perc, {sql.rnd('a.atr14 / nullif(a.close, 0) * 100')} AS atr_pct FROM signals s JOIN atrs a USING (instrument, session)""",
)
def features_with_smoothing(spark, sf_dir):
    """All 21 features, the smoothed ones too."""
    df = signals.signal_table(bars(spark, sf_dir))
    return df.select("instrument", "today", "idx", *_ALL, c.rounded("bb_perc").alias("bb_perc"), c.rounded("atr_pct").alias("atr_pct"))


_LABELS = ["day_to_5", "day_to_10", "day_to_15", "stop_day", *[f"{x}_{t}" for t in (10, 15) for x in ("target_before_stop", "stop_before_target", "target_stop_same_day", "no_target_no_stop", "fast_success", "slow_success", "fail_success")], "target_class"]


@query("labels_forward", f"WITH {sql.SIGNALS} SELECT instrument, session, {', '.join(_LABELS)}, validation_high_rate_max, validation_low_rate_min, validation_close_rate7 FROM signals")
def labels_forward(spark, sf_dir):
    return signal_rows(spark, sf_dir).select(*KEY, *_LABELS, "validation_high_rate_max", "validation_low_rate_min", "validation_close_rate7")


_V1 = ["day_to_4", "day_to_7", "day_to_12", "stop_day", "target_before_stop_7", "stop_before_target_12", "fast_success_7", "target_class"]


@query("labels_first_levels", f"WITH {','.join([sql.BARS, sql.CHANGE, sql.AVERAGES, sql.ANY_DROP, sql.labels((4, 7, 12))])} SELECT instrument, session, {', '.join(_V1)} FROM labelled WHERE fires AND idx >= 70 AND ahead = 7")
def labels_first_levels(spark, sf_dir):
    return signals.signal_table(bars(spark, sf_dir), signals.V1, smooth=False).select(*KEY, *_V1)


@query("forward_rates", f"WITH {','.join([sql.BARS, sql.CHANGE, sql.AVERAGES, sql.ANY_DROP, sql.labels((5, 10, 15))])} SELECT instrument, session, {sql.rnd('h1')} AS validation_high_rate1, {sql.rnd('l3')} AS validation_low_rate3, {sql.rnd('c7')} AS validation_close_rate7 FROM labelled")
def forward_rates(spark, sf_dir):
    return signals.spread_rates(signals.forward_rates(bars(spark, sf_dir))).select(*KEY, "validation_high_rate1", "validation_low_rate3", "validation_close_rate7")


@query("prices_pearson", f"WITH {sql.BARS} SELECT a.instrument AS one, b.instrument AS two, count(*) AS n, round(corr(a.close, b.close), 6) AS r FROM bars a JOIN bars b ON a.session = b.session AND a.instrument < b.instrument WHERE a.instrument < 'Brand#12' AND b.instrument < 'Brand#12' GROUP BY 1, 2")
def prices_pearson(spark, sf_dir):
    b = bars(spark, sf_dir).where("instrument < 'Brand#12'").select("session", "instrument", "close")
    a, d = b.withColumnsRenamed({"instrument": "one", "close": "x"}), b.withColumnsRenamed({"instrument": "two", "close": "y"})
    return a.join(d, "session").where("one < two").groupBy("one", "two").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("x", "y"), 6).alias("r"))


@query("overlay_full_join", f"WITH {sql.BARS}, a AS (SELECT * FROM bars WHERE volume % 2 = 0), b AS (SELECT instrument, session, close * 2 AS close FROM bars WHERE volume % 3 = 0) SELECT coalesce(a.instrument, b.instrument) AS instrument, coalesce(a.session, b.session) AS session, round(coalesce(b.close, a.close), 8) AS close, round(a.volume, 8) AS volume FROM a FULL JOIN b ON a.instrument = b.instrument AND a.session = b.session")
def overlay_full_join(spark, sf_dir):
    b = bars(spark, sf_dir)
    right = b.where("volume % 3 = 0").select(*KEY, (F.col("close") * 2).alias("close"))
    return rounded(cleaning.overlay(b.where("volume % 2 = 0").select(*KEY, "close", "volume"), right, KEY), KEY, ["close", "volume"])


_LONG = ["vol20", "vol30", "mean_ret20", "mean_ret30", "pos20_ratio", "pos30_ratio", "range_3m", "drawdown_3m"]
_simple(
    "longer_features",
    lambda b: signals.longer_features(indicators.daily_change(b)),
    _LONG,
    [sql.BARS, sql.CHANGE, "risen AS (SELECT *, CAST(change_pct > 0 AS INT) AS up FROM changed)"],
    "risen",
    [*[sql.full("stddev_samp", "change_pct", n) for n in (20, 30)], *[sql.full("avg", "change_pct", n) for n in (20, 30)], *[sql.full("avg", "up", n) for n in (20, 30)], f"(({sql.full('max', 'high', 60)}) / nullif({sql.full('min', 'low', 60)}, 0) - 1) * 100", f"(close / nullif({sql.full('max', 'high', 60)}, 0) - 1) * 100"],
    4,
)

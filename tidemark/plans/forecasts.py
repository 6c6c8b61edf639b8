"""Queries over forecast windows, baselines and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import columns as c
from tidemark.functions import windows as w
from tidemark.operators import forecast, importance, metrics
from tidemark.plans import sql
from tidemark.plans.market import KEY, bars, query, rounded

FRAMES = f"""
numbered AS (SELECT *, row_number() OVER ({sql.W}) AS i, floor(count(*) OVER (PARTITION BY instrument) * 0.75) AS cut, list(close) OVER {sql.last(15)} AS x,
  lead(close, 1) OVER ({sql.W}) AS y1, lead(close, 2) OVER ({sql.W}) AS y2, lead(close, 3) OVER ({sql.W}) AS y3 FROM bars),
parted AS (SELECT *, CASE WHEN y3 IS NULL THEN 'predict' WHEN i + 3 <= cut THEN 'train' WHEN i - 15 >= cut THEN 'valid' END AS part FROM numbered WHERE len(x) = 15),
frames AS (SELECT * FROM parted WHERE part IS NOT NULL)"""


def frames(spark, sf_dir):
    return forecast.windows(bars(spark, sf_dir))


@query("forecast_windows", f"WITH {sql.BARS},{FRAMES} SELECT instrument, session, part, round(x[1], 8) AS oldest, round(x[15], 8) AS newest, round(y1, 8) AS next1, round(y3, 8) AS next3 FROM frames")
def forecast_windows(spark, sf_dir):
    f = frames(spark, sf_dir).withColumns({"oldest": F.get("x", F.lit(0)), "newest": F.get("x", F.lit(14)), "next1": F.get("y", F.lit(0)), "next3": F.get("y", F.lit(2))})
    return rounded(f, [*KEY, "part"], ["oldest", "newest", "next1", "next3"])


_ERR = "(abs(y1 - close) / greatest(abs(y1) + abs(close), 1e-12) + abs(y2 - close) / greatest(abs(y2) + abs(close), 1e-12) + abs(y3 - close) / greatest(abs(y3) + abs(close), 1e-12)) * 200 / 3"


@query(
    "naive_eval",
    f"""WITH {sql.BARS},{FRAMES}, long AS (SELECT instrument, close AS p, h, CASE h WHEN 1 THEN y1 WHEN 2 THEN y2 ELSE y3 END AS a FROM frames, range(1, 4) t(h) WHERE part = 'valid'),
    per AS (SELECT instrument, h, avg((a - p) * (a - p)) AS mse, avg(abs(a - p)) AS mae, avg(abs(a - p) / greatest(abs(a), 1e-8)) AS mape, avg(200 * abs(a - p) / greatest(abs(a) + abs(p), 1e-12)) AS smape, var_pop(a) AS v, count(*) AS n FROM long GROUP BY 1, 2)
    SELECT instrument, max(n) AS n, round(avg(mae), 4) AS mae, round(100 * avg(mape), 4) AS mape, round(avg(smape), 4) AS smape, round(avg(1 - mse / nullif(v, 0)), 4) AS r2 FROM per GROUP BY 1""",
)
def naive_eval(spark, sf_dir):
    out = metrics.regression(forecast.naive(frames(spark, sf_dir).where("part = 'valid'")), "y", "naive", ["instrument"])
    return rounded(out, ["instrument", "n"], ["mae", "mape", "smape", "r2"], 4)


@query(
    "mase",
    f"""WITH {sql.BARS},{FRAMES}, steps AS (SELECT instrument, i, cut, abs(close - lag(close) OVER ({sql.W})) AS d FROM numbered), scale AS (SELECT instrument, greatest(avg(d), 1e-12) AS s FROM steps WHERE i <= cut GROUP BY 1),
    e AS (SELECT instrument, avg((abs(y1 - close) + abs(y2 - close) + abs(y3 - close)) / 3) AS m FROM frames WHERE part = 'valid' GROUP BY 1)
    SELECT instrument, round(m / s, 6) AS mase FROM e JOIN scale USING (instrument)""",
)
def mase(spark, sf_dir):
    b = bars(spark, sf_dir)
    valid = forecast.naive(forecast.windows(b).where("part = 'valid'")).withColumn("_e", forecast.absolute("y", "naive")).groupBy("instrument").agg(F.avg("_e").alias("mae"))
    return valid.join(forecast.in_sample_scale(b), "instrument").select("instrument", c.rounded(F.col("mae") / F.col("scale"), 6).alias("mase"))


def drifted(spark, sf_dir):
    """A forecast by the mean of the window, so that everything downstream has SQL."""
    mean = F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / F.size("x")
    return forecast.naive(frames(spark, sf_dir).where("part = 'valid'")).withColumn("predicted", F.array_repeat(mean, 3))


_MEAN = "list_sum(x) / 15"


@query(
    "hit_rate",
    f"""WITH {sql.BARS},{FRAMES}, v AS (SELECT instrument, close, {_MEAN} AS p, y1, y2, y3 FROM frames WHERE part = 'valid')
    SELECT instrument, round((avg(CAST(sign(y1 - close) = sign(p - close) AS INT)) + avg(CAST(sign(y2 - close) = sign(p - close) AS INT)) + avg(CAST(sign(y3 - close) = sign(p - close) AS INT))) / 3, 6) AS hit_rate FROM v GROUP BY 1""",
)
def hit_rate(spark, sf_dir):
    return rounded(forecast.hit_rate(drifted(spark, sf_dir), by=["instrument"]), ["instrument"], ["hit_rate"], 6)


def _sm(p: str) -> str:
    return "(" + " + ".join(f"200 * abs(y{k} - {p}) / greatest(abs(y{k}) + abs({p}), 1e-12)" for k in (1, 2, 3)) + ") / 3"


@query(
    "improvement",
    f"""WITH {sql.BARS},{FRAMES}, v AS (SELECT instrument, {_sm('(' + _MEAN + ')')} AS m, {_sm('close')} AS b FROM frames WHERE part = 'valid'),
    g AS (SELECT instrument, avg(m) AS m, avg(b) AS b, avg(CAST(m < b AS INT)) AS share, count(*) AS n FROM v GROUP BY 1)
    SELECT instrument, n, round(m, 4) AS smape, round(b, 4) AS naive_smape, round(share, 6) AS improved_share, ((b - m) / nullif(b, 0) >= 0.03 OR b - m >= 0.2) AND share >= CASE WHEN n < 80 THEN 0.55 ELSE 0.6 END AS improves FROM g""",
)
def improvement(spark, sf_dir):
    out = forecast.improvement(drifted(spark, sf_dir), ["instrument"])
    return out.select("instrument", "n", c.rounded("smape", 4).alias("smape"), c.rounded("naive_smape", 4).alias("naive_smape"), c.rounded("improved_share", 6).alias("improved_share"), "improves")


@query(
    "alpha_blend",
    f"""WITH {sql.BARS},{FRAMES}, v AS (SELECT instrument, a / 20.0::DOUBLE AS alpha, a / 20.0::DOUBLE * ({_MEAN}) + (1 - a / 20.0::DOUBLE) * close AS p, y1, y2, y3 FROM frames, range(21) t(a) WHERE part = 'valid'),
    e AS (SELECT instrument, alpha, round(avg({_sm('p')}), 9) AS s FROM v GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY s, alpha) AS i, max(CASE WHEN alpha = 0 THEN s END) OVER (PARTITION BY instrument) AS naive FROM e)
    SELECT instrument, alpha, round(s, 4) AS smape, s <= naive * 0.98 AS accepted FROM k WHERE i = 1""",
)
def alpha_blend(spark, sf_dir):
    return forecast.alpha_blend(drifted(spark, sf_dir), ["instrument"]).select("instrument", "alpha", c.rounded("smape", 4).alias("smape"), "accepted")


@query("forecast_linear")
def forecast_linear(spark, sf_dir):
    """The least-squares forecaster through the model seam, gated and blended."""
    f = forecast.naive(forecast.forecast(frames(spark, sf_dir)).where("part = 'valid'"))
    out = metrics.regression(f, "y", "predicted", ["instrument"]).join(forecast.hit_rate(f, by=["instrument"]).drop("by_horizon"), "instrument")
    return forecast.quality_gate(out, most_smape=100, least_r2=-1).join(forecast.alpha_blend(f, ["instrument"]).select("instrument", "alpha", "accepted"), "instrument")


@query("lag_importance")
def lag_importance(spark, sf_dir):
    return forecast.permutation_importance(frames(spark, sf_dir)).groupBy("lag").agg(F.avg("importance").alias("importance"))


@query("standardised", f"WITH {sql.BARS}, k AS (SELECT *, row_number() OVER ({sql.W}) <= floor(count(*) OVER (PARTITION BY instrument) * 0.75) AS tr FROM bars), f AS (SELECT instrument, avg(close) AS m, stddev_pop(close) AS s FROM k WHERE tr GROUP BY 1) SELECT instrument, session, round((close - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) AS close_scaled FROM k JOIN f USING (instrument)")
def standardised(spark, sf_dir):
    from tidemark.functions import windows as w

    b = bars(spark, sf_dir).withColumn("train", F.row_number().over(w.by()) <= F.floor(F.count(F.lit(1)).over(w.Window.partitionBy("instrument")) * 0.75))
    return rounded(forecast.standardised(b, ["close"], F.col("train"), ["instrument"]), KEY, ["close_scaled"], 6)


@query(
    "recursive_forecast",
    f"""WITH RECURSIVE {sql.BARS},{FRAMES}, steps(instrument, session, x, k) AS (SELECT instrument, session, x, 0 FROM frames WHERE part = 'valid'
      UNION ALL SELECT instrument, session, list_append(x[2:], list_sum(x) / 15), k + 1 FROM steps WHERE k < 3)
    SELECT instrument, session, round(x[13], 6) AS next1, round(x[14], 6) AS next2, round(x[15], 6) AS next3 FROM steps WHERE k = 3""",
)
def recursive_forecast(spark, sf_dir):
    """Three steps ahead, each the mean of a window that the steps before have moved on."""
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    f = frames(spark, sf_dir).where("part = 'valid'").withColumn("p", forecast.recursive(F.col("x"), mean, 3))
    return f.select(*KEY, *[c.rounded(F.get("p", F.lit(k)), 6).alias(f"next{k + 1}") for k in range(3)])


@query("forest_importance")
def forest_importance(spark, sf_dir):
    """How much R2 of a forest falls when the close or the volume of a window is shuffled, summed over lags."""
    steps = lambda x: F.transform(x, lambda v: F.try_divide(v, F.element_at(x, -1)))
    b = bars(spark, sf_dir).withColumn("_v", F.array_compact(F.collect_list("volume").over(w.last(15))))
    volumes = b.where(F.size("_v") == 15).select(*KEY, steps(F.col("_v")).alias("volume"))
    f = frames(spark, sf_dir).where("part <> 'predict'").join(volumes, KEY).withColumn("y1", F.try_divide(F.get("y", F.lit(0)), "base"))
    rows, names = importance.flat(f.withColumn("close", steps(F.col("x"))), ["close", "volume"], 15, [*KEY, "part", "y1"])
    inputs = [n for n in names if not n.endswith("_t-0")]  # a window's newest value is what the others are taken from
    train = rows.where("part = 'train'").repartition("instrument").sortWithinPartitions(*KEY)
    model = importance.fitted(train, inputs, "y1", trees=10)
    found = importance.permutation(model, rows.where("part = 'valid'"), KEY, inputs, "y1", seeds=(1, 2))
    return importance.by_base(found).select("feature", c.rounded("importance", 6).alias("importance"))

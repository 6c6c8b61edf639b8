"""Forecast windows, baselines, evaluation, gates and blending.

The model is a seam: ``forecast`` takes a function over one instrument's windows and
runs it with applyInPandas; a naive and a least-squares forecaster are given.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as w
from tidemark.functions.columns import ratio

LOOK_BACK, HORIZON, SPLIT = 15, 3, 0.75


def windows(bars: DataFrame, value: str = "close", look_back: int = LOOK_BACK, horizon: int = HORIZON, split: float = SPLIT) -> DataFrame:
    """One row for each whole window: x (the last ``look_back`` values, today included),
    y (the next ``horizon``), base (today's), and part.

    Windows whose future ends within the first ``split`` of an instrument's rows train,
    those whose past starts after it validate; windows across are left out (no leak). The
    last rows, without a future, are ``predict``.
    """
    every = Window.partitionBy("instrument")
    df = bars.withColumns(
        {
            "x": F.collect_list(value).over(w.last(look_back)),
            "y": F.array(*[w.lead(value, k) for k in range(1, horizon + 1)]),
            "base": F.col(value),
            "_i": F.row_number().over(w.by()),
            "_cut": F.floor(F.count(F.lit(1)).over(every) * split),
        }
    ).where(F.size("x") == look_back)
    whole = F.forall("y", lambda v: v.isNotNull())
    part = F.when(~whole, "predict").when(F.col("_i") + horizon <= F.col("_cut"), "train").when(F.col("_i") - look_back >= F.col("_cut"), "valid")
    return df.withColumn("part", part).where("part is not null").select("instrument", "session", "x", "y", "base", "part")


def standardised(df: DataFrame, columns: list[str], train: Column, by: list[str] | None = None) -> DataFrame:
    """Columns as (x - mean) / population deviation, both of the training rows; the fit stays beside."""
    by = by or []
    fit = df.where(train).groupBy(*by).agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))])
    out = df.join(fit, by, "left") if by else df.crossJoin(F.broadcast(fit))  # without groups: one row
    return out.withColumns({f"{c}_scaled": F.try_divide(F.col(c) - F.col(f"{c}_mean"), F.when(F.col(f"{c}_std") > 0, F.col(f"{c}_std")).otherwise(1.0)) for c in columns})


def restored(c: str, scaled: Column) -> Column:
    """The inverse of standardised() for one column."""
    return scaled * F.when(F.col(f"{c}_std") > 0, F.col(f"{c}_std")).otherwise(1.0) + F.col(f"{c}_mean")


def min_max(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    every = Window.partitionBy(*by)
    return df.withColumns({f"{c}_unit": ratio(F.col(c) - F.min(c).over(every), F.max(c).over(every) - F.min(c).over(every)) for c in columns})


def naive(df: DataFrame, horizon: int = HORIZON, space: str = "price") -> DataFrame:
    """Adds naive: today's value again and again, or no return."""
    return df.withColumn("naive", F.array_repeat(F.col("base") if space == "price" else F.lit(0.0), horizon))


def naive_model(train: np.ndarray, targets: np.ndarray, ask: np.ndarray) -> np.ndarray:
    return np.repeat(ask[:, -1:], targets.shape[1], axis=1)


def linear_model(train: np.ndarray, targets: np.ndarray, ask: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Least squares from the window, relative to its last value."""
    if not len(train):
        return naive_model(train, targets, ask)
    a = np.hstack([train / np.where(train[:, -1:] == 0, 1, train[:, -1:]), np.ones((len(train), 1))])
    b = targets / np.where(train[:, -1:] == 0, 1, train[:, -1:])
    beta = np.linalg.solve(a.T @ a + ridge * np.eye(a.shape[1]), a.T @ b)
    scale = np.where(ask[:, -1:] == 0, 1, ask[:, -1:])
    return (np.hstack([ask / scale, np.ones((len(ask), 1))]) @ beta) * scale


def forecast(frames: DataFrame, model: Callable = linear_model, horizon: int = HORIZON) -> DataFrame:
    """Windows that aren't for training, with ``predicted`` by a model fitted per instrument.

    An instrument's windows are bounded by its sessions; instruments are independent.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        train, ask = pdf[pdf.part == "train"], pdf[pdf.part != "train"]
        if ask.empty:
            return pd.DataFrame(columns=["instrument", "session", "x", "y", "base", "part", "predicted"])
        x = np.array(train.x.tolist(), float).reshape(len(train), -1)
        y = np.array(train.y.tolist(), float).reshape(len(train), horizon)
        return ask.assign(predicted=list(model(x, y, np.array(ask.x.tolist(), float))))

    return frames.groupBy("instrument").applyInPandas(run, "instrument string, session date, x array<double>, y array<double>, base double, part string, predicted array<double>")


def recursive(x: Column, step: Callable[[Column], Column], n: int) -> Column:
    """n values, each from the window that the ones before have moved on."""
    start = F.struct(x.alias("x"), F.array().cast("array<double>").alias("out"))

    def add(acc, _):
        v = step(acc["x"])
        return F.struct(F.concat(F.slice(acc["x"], 2, F.size(acc["x"])), F.array(v)).alias("x"), F.concat(acc["out"], F.array(v)).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, add, lambda acc: acc["out"])


def smape(actual: str, predicted: str) -> Column:
    """Of one window, in percent, mean over the horizon."""
    parts = F.zip_with(actual, predicted, lambda a, p: 200 * F.abs(a - p) / F.greatest(F.abs(a) + F.abs(p), F.lit(1e-12)))
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v) / F.size(actual)


def absolute(actual: str, predicted: str) -> Column:
    return F.aggregate(F.zip_with(actual, predicted, lambda a, p: F.abs(a - p)), F.lit(0.0), lambda s, v: s + v) / F.size(actual)


def in_sample_scale(bars: DataFrame, value: str = "close", split: float = SPLIT, m: int = 1) -> DataFrame:
    """Mean absolute step of each instrument's first ``split`` rows: what MASE divides by."""
    every = Window.partitionBy("instrument")
    df = bars.withColumns({"_i": F.row_number().over(w.by()), "_n": F.count(F.lit(1)).over(every), "_d": F.abs(F.col(value) - w.lag(value, m))})
    return df.where(F.col("_i") <= F.floor(F.col("_n") * split)).groupBy("instrument").agg(F.greatest(F.avg("_d"), F.lit(1e-12)).alias("scale"))


def hit_rate(df: DataFrame, actual: str = "y", predicted: str = "predicted", base: str | None = "base", by: list[str] | None = None) -> DataFrame:
    """Share of equal signs of change by horizon, and their mean."""
    z = df.select(*(by or []), F.posexplode(F.arrays_zip(F.col(actual).alias("a"), F.col(predicted).alias("p"))).alias("h", "v"), *([base] if base else []))
    zero = F.col(base) if base else F.lit(0.0)
    hit = (F.signum(F.col("v.a") - zero) == F.signum(F.col("v.p") - zero)).cast("double")
    per = z.groupBy(*(by or []), "h").agg(F.avg(hit).alias("rate"))
    return per.groupBy(*(by or [])).agg(F.avg("rate").alias("hit_rate"), F.array_sort(F.collect_list(F.struct("h", "rate"))).alias("by_horizon"))


def improvement(df: DataFrame, by: list[str], actual: str = "y", predicted: str = "predicted", base_line: str = "naive", relative: float = 0.03, absolute_gain: float = 0.2, share: float = 0.6, small: int = 80, small_share: float = 0.55, rescue: float = 0.05) -> DataFrame:
    """Whether a model beats its baseline: by share or points of sMAPE, in enough windows.

    With few windows the share needed is lower; a model that isn't worse by more than
    ``rescue`` points but wins far more windows than needed is kept too.
    """
    rows = df.withColumns({"_m": smape(actual, predicted), "_b": smape(actual, base_line)})
    out = rows.groupBy(*by).agg(F.avg("_m").alias("smape"), F.avg("_b").alias("naive_smape"), F.avg((F.col("_m") < F.col("_b")).cast("double")).alias("improved_share"), F.count(F.lit(1)).alias("n"))
    need = F.when(F.col("n") < small, small_share).otherwise(share)
    gain = F.col("naive_smape") - F.col("smape")
    better = (F.try_divide(gain, F.col("naive_smape")) >= relative) | (gain >= absolute_gain)
    out = out.withColumn("improves", F.coalesce(better & (F.col("improved_share") >= need), F.lit(False)))
    return out.withColumn("rescued", ~F.col("improves") & (gain > -rescue) & (F.col("improved_share") >= need + 0.1))


def quality_gate(metrics: DataFrame, most_smape: float = 10.0, least_r2: float = 0.0, least_n: int = 30, least_hit: float = 0.5) -> DataFrame:
    """Adds ok and the reasons a model is turned down."""
    checks = [("smape", F.col("smape") <= most_smape), ("r2", F.col("r2") >= least_r2), ("samples", F.col("n") >= least_n), ("hit_rate", F.col("hit_rate") >= least_hit)]
    bad = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks]), lambda x: x.isNotNull())
    return metrics.withColumn("reasons", F.array_join(bad, ",")).withColumn("ok", F.col("reasons") == "")


def alpha_blend(df: DataFrame, by: list[str], steps: int = 20, actual: str = "y", predicted: str = "predicted", base_line: str = "naive", relative: float = 0.98) -> DataFrame:
    """The weight of the model (of ``steps`` + 1 in a grid) whose blend has the least sMAPE,
    the smaller on ties; accepted if that is below the baseline's by the relative bound."""
    grid = F.explode(F.array(*[F.lit(i / steps) for i in range(steps + 1)])).alias("alpha")
    rows = df.select(*by, actual, predicted, base_line, grid)
    rows = rows.withColumn("_mix", F.zip_with(predicted, base_line, lambda p, n: F.col("alpha") * p + (1 - F.col("alpha")) * n))
    per = rows.withColumn("_e", smape(actual, "_mix")).groupBy(*by, "alpha").agg(F.round(F.avg("_e"), 9).alias("smape"))
    out = per.groupBy(*by).agg(F.min_by("alpha", F.struct("smape", "alpha")).alias("alpha"), F.min("smape").alias("smape"), F.max(F.when(F.col("alpha") == 0, F.col("smape"))).alias("naive_smape"))
    return out.withColumn("accepted", F.col("smape") <= F.col("naive_smape") * relative)


def permutation_importance(frames: DataFrame, seeds: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """How much worse a fitted linear model gets when one lag of the window is shuffled."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        train, valid = pdf[pdf.part == "train"], pdf[pdf.part == "valid"]
        if train.empty or valid.empty:
            return pd.DataFrame(columns=["instrument", "lag", "importance"])
        x, y, vx, vy = (np.array(v.tolist(), float) for v in (train.x, train.y, valid.x, valid.y))
        base = np.abs(linear_model(x, y, vx) - vy).mean()
        out = []
        for lag in range(vx.shape[1]):
            worse = []
            for seed in seeds:
                z = vx.copy()
                z[:, lag] = np.random.default_rng(seed).permutation(z[:, lag])
                worse.append(np.abs(linear_model(x, y, z) - vy).mean() - base)
            out.append((pdf.instrument.iloc[0], vx.shape[1] - 1 - lag, max(0.0, float(np.mean(worse)))))
        return pd.DataFrame(out, columns=["instrument", "lag", "importance"])

    return frames.groupBy("instrument").applyInPandas(run, "instrument string, lag int, importance double")

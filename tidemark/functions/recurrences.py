"""Exponential smoothing of an instrument's ordered bars.

A recurrence has no window function, and written as a fold over an array every series
that builds on another repeats its whole expression. So each instrument's bars, which
its number of sessions bounds, go to pandas once, and all series are smoothed there in
compiled code. Smoothing starts at the first value; a null carries the level on, and the
next value weighs more by the steps in between.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType


def ema(s: pd.Series, span: int) -> pd.Series:
    return s.ewm(span=span, adjust=False).mean()


def wilder(s: pd.Series, length: int) -> pd.Series:
    return s.ewm(alpha=1.0 / length, adjust=False).mean()


def smooth(df: DataFrame, inputs: list[str], series: dict[str, Callable[[pd.DataFrame], pd.Series]], keep: list[str]) -> DataFrame:
    """``series``: name to a function of the instrument's bars in order, to which the series
    before it have been added. Returns instrument, session, ``keep`` and the series."""
    cols = list(dict.fromkeys(["instrument", "session", *keep]))
    sent = df.select(*dict.fromkeys([*cols, *inputs]))
    kind = StructType([*[sent.schema[c] for c in cols], *[StructField(n, DoubleType()) for n in series]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("session", ignore_index=True)
        for name, f in series.items():
            pdf[name] = f(pdf)
        found = pdf[list(series)]
        pdf[list(series)] = found.astype(object).where(found.notna(), None)
        return pdf[[*cols, *series]]

    return sent.groupBy("instrument").applyInPandas(run, kind)

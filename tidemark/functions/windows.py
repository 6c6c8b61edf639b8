"""Frames over an instrument's sessions. All share one partitioning and order, so a
query that uses many of them sorts and shuffles once."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import col

KEY, ORDER = "instrument", "session"


def by() -> Window:
    return Window.partitionBy(KEY).orderBy(ORDER)


def last(n: int):
    """The last n rows, today included."""
    return by().rowsBetween(-(n - 1), 0)


def before(n: int):
    """The n rows before today."""
    return by().rowsBetween(-n, -1)


def ahead(n: int):
    """The next n rows."""
    return by().rowsBetween(1, n)


def so_far():
    return by().rowsBetween(Window.unboundedPreceding, 0)


def full(agg, c: str | Column, n: int, frame=None) -> Column:
    """An aggregate that is null until n values that aren't null are in the frame."""
    frame = last(n) if frame is None else frame
    return F.when(F.count(col(c)).over(frame) == n, agg(col(c)).over(frame))


def mean(c, n: int) -> Column:
    return full(F.avg, c, n)


def std(c, n: int) -> Column:
    return full(F.stddev_samp, c, n)


def total(c, n: int) -> Column:
    return full(F.sum, c, n)


def lag(c: str | Column, n: int = 1) -> Column:
    return F.lag(col(c), n).over(by())


def lead(c: str | Column, n: int = 1) -> Column:
    return F.lead(col(c), n).over(by())

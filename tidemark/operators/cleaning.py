"""Halt repair, usability flags and upserts of bars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as w
from tidemark.functions.columns import finite

PRICES = ("open", "high", "low", "close")


def repaired(bars: DataFrame, chain: bool = False) -> DataFrame:
    """Bars with halt days repaired and a ``valid`` flag.

    On a day without volume, open, high and close become the close of the day before
    (as delivered; with ``chain`` the last one that isn't null or 0), and a low that is
    missing, 0 or below, or above the high becomes it too.
    """
    bars = bars.select(*[finite(c).alias(c) if c in (*PRICES, "volume") else F.col(c) for c in bars.columns])
    previous = F.last(F.when(F.col("close") > 0, F.col("close")), ignorenulls=True).over(w.before(1 << 30)) if chain else w.lag("close")
    halt = F.coalesce(F.col("volume"), F.lit(0.0)) <= 0
    df = bars.withColumn("prev_close", previous).withColumn("halted", halt)
    fixed = lambda c: F.when(F.col("halted"), F.col("prev_close")).otherwise(F.col(c))
    df = df.withColumn("low", F.when(F.col("halted") & (F.col("low").isNull() | (F.col("low") <= 0) | (F.col("low") > F.col("prev_close"))), F.col("prev_close")).otherwise(F.col("low")))
    df = df.withColumns({c: fixed(c) for c in ("open", "high", "close")})
    there = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*PRICES, "volume")])
    positive = reduce(lambda a, b: a & b, [F.col(c) > 0 for c in PRICES])
    valid = F.coalesce(there & positive & (F.col("high") >= F.col("low")), F.lit(False))
    return df.withColumn("valid", valid).drop("prev_close")


def drop_halts(bars: DataFrame, chain: bool = False) -> DataFrame:
    """Repaired bars without those that stay invalid."""
    return repaired(bars, chain).where("valid").drop("valid", "halted")


def sparse_profile(bars: DataFrame, columns: list[str], most: float = 0.1) -> DataFrame:
    """Share of nulls and of infinities by instrument and column, and whether the column is usable."""
    shares = []
    for c in columns:
        shares += [F.avg((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("double")).alias(f"null_{c}"), F.avg(F.coalesce(F.abs(F.col(c)) == float("inf"), F.lit(False)).cast("double")).alias(f"inf_{c}")]
    wide = bars.groupBy("instrument").agg(*shares)
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"null_{c}").alias("null_share"), F.col(f"inf_{c}").alias("inf_share")) for c in columns]))
    return wide.select("instrument", rows).withColumn("usable", (F.col("null_share") <= most) & (F.col("inf_share") <= most))


def upsert(current: DataFrame, delivered: DataFrame, order: str = "delivered_at") -> DataFrame:
    """One bar for each instrument and session: the one delivered last."""
    rows = current.unionByName(delivered, allowMissingColumns=True)
    latest = Window.partitionBy("instrument", "session").orderBy(F.desc_nulls_last(order))
    return rows.withColumn("_rank", F.row_number().over(latest)).where("_rank = 1").drop("_rank")


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def union_first_wins(frames: list[DataFrame], keys: list[str], order: list) -> DataFrame:
    """All frames' rows; of equal keys that of the earliest frame."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("_source", F.lit(i)) for i, f in enumerate(frames)])
    return first_of(rows, keys, [F.col("_source"), *order]).drop("_source")


def overlay(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of both; right's values where it has them."""
    values = [c for c in left.columns if c not in keys]
    joined = left.alias("a").join(right.alias("b"), keys, "full")
    return joined.select(*keys, *[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) if c in right.columns else F.col(f"a.{c}") for c in values])

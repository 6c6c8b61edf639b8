"""Weekly and monthly bars, market breadth and lookups in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import windows as w
from tidemark.functions.columns import month_of, rounded, week_of


def bars_by(bars: DataFrame, period: Column, name: str) -> DataFrame:
    """Open of the first and close of the last session that has one, per period."""
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("session"))
    out = bars.groupBy("instrument", period.alias(name)).agg(
        F.min_by("open", at("open")).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at("close")).alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("sessions")
    )
    return out.where("close is not null")


def weekly(bars: DataFrame) -> DataFrame:
    return bars_by(bars, week_of("session"), "week")


def monthly(bars: DataFrame) -> DataFrame:
    return bars_by(bars, month_of("session"), "month")


def breadth(changes: DataFrame) -> DataFrame:
    """Market context per session and market: mean change, mean 5-day return, share rising, count.

    ``changes``: bars with change_pct.
    """
    df = changes.withColumn("_five", (F.try_divide(F.col("close"), w.lag("close", 5)) - 1) * 100)
    return df.groupBy("session", "market").agg(
        F.avg("change_pct").alias("market_today_pct"), F.avg("_five").alias("market_5d_pct"), F.avg((F.col("change_pct") > 0).cast("double")).alias("market_breadth_up_ratio"), F.count(F.lit(1)).alias("market_stock_count")
    )


def with_context(rows: DataFrame, context: DataFrame) -> DataFrame:
    """Rows with their market's context; a miss has nulls and a count of 0."""
    return rows.join(context, ["session", "market"], "left").withColumn("market_stock_count", F.coalesce("market_stock_count", F.lit(0).cast("long")))


def previous_close(bars: DataFrame) -> DataFrame:
    """The last close that isn't null, strictly before the session."""
    return bars.withColumn("asof_close", F.last("close", ignorenulls=True).over(w.by().rowsBetween(w.Window.unboundedPreceding, -1)))


def asof(left: DataFrame, right: DataFrame, on: str = "session", value: str = "close") -> DataFrame:
    """Left rows with the newest value of right strictly before them, by instrument.

    Both sides go into one ordering by instrument, so there is one shuffle and no range join.
    """
    a = left.select("*", F.lit(0).alias("_side"), F.lit(None).cast("double").alias("_value"))
    b = right.select(*[F.col(c) if c in ("instrument", on) else F.lit(None).cast(t).alias(c) for c, t in left.dtypes], F.lit(1).alias("_side"), F.col(value).cast("double").alias("_value"))
    seen = w.Window.partitionBy("instrument").orderBy(on, "_side").rowsBetween(w.Window.unboundedPreceding, -1)
    return a.unionByName(b).withColumn("asof_value", F.last("_value", ignorenulls=True).over(seen)).where("_side = 0").drop("_side", "_value")


def weekly_changes(bars: DataFrame) -> DataFrame:
    """Percent against last week's and the close four weeks ago; null with too few weeks.

    On a week's first bar the close before it is last week's; what that bar carried as
    n weeks ago is n + 1 weeks ago from here on. All steps are windows over one ordering.
    """
    df = bars.withColumn("_week", week_of("session"))
    df = df.withColumns({"_fresh": F.col("_week") != w.lag("_week"), "_w0": F.last("close", ignorenulls=True).over(w.so_far())})
    for n in range(1, 5):
        df = df.withColumn(f"_p{n}", F.when(F.col("_fresh"), w.lag(f"_w{n - 1}")))
        df = df.withColumn(f"_w{n}", F.last(f"_p{n}", ignorenulls=True).over(w.so_far()))
    change = lambda n: F.try_divide(F.col("close"), F.col(f"_w{n}")) - 1
    out = df.withColumns({"pct_vs_lastweek": rounded(change(1) * 100), "pct_vs_last4week": rounded(change(4) * 100), "is_drop_more_than_minus1pct": change(1) < -0.01})
    return out.drop("_week", "_fresh", "_w0", *[f"_{x}{n}" for n in range(1, 5) for x in "pw"])

"""Exact quantiles of many groups by passes over the ordered bits of doubles.

The bits of a double, turned so that they order like its value, are read 16 at a time: a
pass counts the rows of each prefix that a wanted rank may lie in, running sums over the
prefixes of a group find the one that holds it, and the next pass looks only at rows with
that prefix. After four passes all bits are known. No task holds the values of a group:
counts are summed before they are shuffled, and a prefix has at most 65,536 next ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.folders import kept
from tidemark.operators.metrics import long_form

WIDTH = 16


def ordered_bits(value: Column) -> Column:
    """A long that orders like the double: all bits of negative numbers are turned but the first.
    Minus zero is zero; null stays null."""
    raw = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), value + 0.0).cast("long")
    return F.when(value.isNull(), None).when(raw < 0, raw.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(raw)


def from_ordered_bits(bits: Column) -> Column:
    raw = F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)
    return F.call_function("java_method", F.lit("java.lang.Double"), F.lit("longBitsToDouble"), raw).cast("double")


def quantiles(df: DataFrame, features: list[str], grid: list[float], by: list[str] | None = None) -> DataFrame:
    """by, feature, q, value: linear quantiles of each feature in each group, as by ``percentile``.

    Nulls don't count; a feature without values in a group gives no row there. The table of
    wanted ranks (groups times features times twice the grid) is written after each pass and
    joined: Spark broadcasts it while it is small.
    """
    by = by or []
    keys = [*by, "feature"]
    long = long_form(df, features, [F.col(c) for c in by]).where(F.col("value").isNotNull() & ~F.isnan("value")).select(*keys, ordered_bits(F.col("value")).alias("_bits"))

    n = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    at = F.col("_q") * (F.col("_n") - 1)
    ranks = n.select(*keys, "_n", F.explode(F.array(*[F.lit(float(q)) for q in grid])).alias("_q"))
    ranks = ranks.select(*keys, "_q", at.alias("_at"), F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("_rank"))
    wanted = ranks.withColumns({"_left": F.col("_rank"), "_prefix": F.lit(0).cast("long")})
    for step in range(64 // WIDTH):
        shift = 64 - WIDTH * (step + 1)
        # the first 16 bits carry the sign, so that prefixes order as numbers
        prefix = F.shiftright("_bits", shift)
        if step:
            held = wanted.select(*keys, F.col("_prefix").alias("_held")).distinct()
            part = long.join(held.withColumnsRenamed({c: f"_w_{c}" for c in keys}), [*[F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in keys], F.shiftright("_bits", shift + WIDTH) == F.col("_held")]).select(*keys, "_held", prefix.alias("_next"))
        else:
            part = long.select(*keys, F.lit(0).cast("long").alias("_held"), prefix.alias("_next"))
        counts = part.groupBy(*keys, "_held", "_next").agg(F.count(F.lit(1)).alias("_c"))
        below = Window.partitionBy(*keys, "_held").orderBy("_next").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(below), F.lit(0))).withColumnsRenamed({c: f"_w_{c}" for c in keys})
        on = [*[F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in keys], F.col("_prefix") == F.col("_held"), F.col("_left") >= F.col("_before"), F.col("_left") < F.col("_before") + F.col("_c")]
        wanted = wanted.join(counts, on).select(*keys, "_q", "_at", "_rank", (F.col("_left") - F.col("_before")).alias("_left"), F.col("_next").alias("_prefix"))
        wanted = kept(wanted, "ranks")
    value = from_ordered_bits(F.col("_prefix"))
    low, high = F.min_by("_v", "_rank"), F.max_by("_v", "_rank")
    out = wanted.withColumn("_v", value).groupBy(*keys, "_q", "_at").agg(low.alias("_low"), high.alias("_high"))
    between = (F.ceil("_at") - F.col("_at")) * F.col("_low") + (F.col("_at") - F.floor("_at")) * F.col("_high")
    return out.select(*keys, F.col("_q").alias("q"), F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(between).alias("value"))

"""How much worse a forest gets when one of its inputs is shuffled.

A column is shuffled across the whole table without one task that holds it: rows are
numbered in one order and in another that a hash with a seed gives, and a row gets the value
of the row whose second number equals its first. The numbers come from a range sort: an
index within each partition, and the rows of the partitions before, of which there are few.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.folders import kept


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Rows with their number from 0 in an order, which should be total for a result that repeats."""
    inside = F.monotonically_increasing_id()
    rows = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", inside), "numbered")
    part, index = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))  # a row a partition
    return rows.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, index + F.col("_start")).drop("_id", "_part", "_start")


def shuffled(df: DataFrame, keys: list[str], columns: list[str], seed: int) -> DataFrame:
    """Rows with ``other_<column>``: the columns of another row, each row's taken once. ``keys`` tell rows apart."""
    first = numbered(df, [F.xxhash64(*keys), *keys], "_at")
    second = numbered(df.select(*keys, *columns), [F.xxhash64(F.lit(seed), *keys), *keys], "_at")
    return first.join(second.select("_at", *[F.col(c).alias(f"other_{c}") for c in columns]), "_at").drop("_at")


def fitted(train: DataFrame, inputs: list[str], label: str, trees: int = 20, depth: int = 5, seed: int = 42) -> RandomForestRegressionModel:
    """A forest on the rows that have all inputs and the label; these are written once and read for every level."""
    rows = train.select(*[F.col(c).cast("double").alias(c) for c in inputs], F.col(label).cast("double").alias("_y")).dropna()
    rows = kept(rows.select(F.array(*inputs).alias("_v"), "_y"), "train").select(array_to_vector("_v").alias("features"), "_y")
    return RandomForestRegressor(labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def _r2(error, label):
    return 1 - F.try_divide(F.avg(error * error), F.var_pop(label))


def permutation(model: RandomForestRegressionModel, valid: DataFrame, keys: list[str], inputs: list[str], label: str, seeds: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """input, importance: by how much R2 on ``valid`` falls on average when an input is shuffled.

    For each seed the table is shuffled once; every row is then predicted once for each input,
    with that input's value taken from the other row.
    """
    rows = valid.select(*keys, *[F.col(c).cast("double").alias(c) for c in inputs], F.col(label).cast("double").alias("_y")).dropna(subset=[*inputs, "_y"])
    rows = kept(rows.withColumn("_v", F.array(*inputs)), "valid").select(*keys, "_v", "_y")

    def scored(df: DataFrame, by: list[str]) -> DataFrame:
        got = model.setPredictionCol("_p").transform(df.select(*by, "_y", array_to_vector("_v").alias("features")))
        return got.groupBy(*by).agg(_r2(F.col("_y") - F.col("_p"), F.col("_y")).alias("r2"))

    whole = scored(rows, []).first().r2
    if whole is None:
        return rows.sparkSession.createDataFrame([], "input string, importance double")
    out = None
    for seed in seeds:
        pairs = shuffled(rows, keys, ["_v"], seed)
        each = pairs.select(F.posexplode(F.array(*[F.lit(c) for c in inputs])).alias("_i", "input"), "_v", "other__v", "_y")
        mixed = each.withColumn("_v", F.expr("transform(_v, (v, i) -> if(i = _i, get(other__v, i), v))"))
        found = scored(mixed, ["input"]).withColumn("fall", F.lit(whole) - F.col("r2"))
        out = found if out is None else out.unionByName(found)
    return out.groupBy("input").agg(F.avg("fall").alias("importance"))


def by_base(importances: DataFrame) -> DataFrame:
    """feature, importance: sums over the lags of ``<feature>_t-<lag>``; what is negative counts as 0."""
    base = F.regexp_replace("input", r"_t-?\d+$", "")
    return importances.groupBy(base.alias("feature")).agg(F.sum(F.greatest(F.col("importance"), F.lit(0.0))).alias("importance"))


def flat(frames: DataFrame, arrays: list[str], size: int, keep: list[str]) -> tuple[DataFrame, list[str]]:
    """Windows as columns ``<array>_t-<lag>``, the newest with lag 0, and these columns' names."""
    names = [f"{a}_t-{size - 1 - i}" for a in arrays for i in range(size)]
    return frames.select(*keep, *[F.get(a, F.lit(i)).alias(f"{a}_t-{size - 1 - i}") for a in arrays for i in range(size)]), names

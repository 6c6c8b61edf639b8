"""Sinks that tell what they wrote: a row for each table of a run, from metrics that are
gathered while the table is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA = "run string, artefact string, rows long, metrics map<string, double>"


class Run:
    """Tables of one run below a folder, and their summary.

    ``write`` returns when the table is complete. Its summary is a file of its own, written
    after it, so a table without a summary was never finished, and runs don't disturb each other.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str):
        self.spark, self.folder, self.name = spark, folder.rstrip("/"), name

    def path(self, artefact: str) -> str:
        return f"{self.folder}/{self.name}/{artefact}"

    def write(self, df: DataFrame, artefact: str, metrics: dict[str, Column] | None = None) -> dict[str, float]:
        """Writes a table and its summary; ``metrics`` are aggregates over its rows. One pass over the rows:
        the aggregates are taken where the rows go by. Null metrics are left out of the summary."""
        if {"rows"} & set(metrics or {}):
            raise ValueError("rows are always counted")
        seen = Observation(f"{self.name}-{artefact}")
        watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[m.cast("double").alias(n) for n, m in (metrics or {}).items()])
        watched.write.mode("overwrite").parquet(self.path(artefact))
        got = seen.get
        rows = int(got.get("rows") or 0)
        found = {n: float(got[n]) for n in metrics or {} if got.get(n) is not None}
        line = self.spark.createDataFrame([(self.name, artefact, rows, found)], SCHEMA)
        line.coalesce(1).write.mode("overwrite").json(f"{self.folder}/_summaries/run={self.name}/artefact={artefact}")
        return {"rows": rows, **found}

    def read(self, artefact: str) -> DataFrame:
        return self.spark.read.parquet(self.path(artefact))


def summaries(spark: SparkSession, folder: str) -> DataFrame:
    """All runs' summaries: run, artefact, rows, metrics."""
    return spark.read.schema(SCHEMA.replace("run string, artefact string, ", "")).option("basePath", f"{folder}/_summaries").json(f"{folder}/_summaries/run=*/artefact=*").select(F.col("run").cast("string").alias("run"), F.col("artefact").cast("string").alias("artefact"), "rows", "metrics")


def latest(found: DataFrame) -> DataFrame:
    """The last run's row of each artefact, by the runs' names."""
    return found.groupBy("artefact").agg(F.max_by(F.struct("run", "rows", "metrics"), "run").alias("x")).select("artefact", "x.*")

"""The best rows of a table by a bounded heap in every task, merged level by level.

A task holds at most ``k`` rows and one batch more, and hands on ``k``; the next level
does the same with the rows of several tasks. So no task sorts, and none but the last
sees more than its share of the tops. The order is total once the last column is a key,
and then the result is that of a full sort, however rows are dealt.
"""

from __future__ import annotations

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Order = list[tuple[str, bool]]


class Bounded:
    """The best ``k`` rows so far; two of these merge by taking in each other's rows."""

    def __init__(self, k: int, order: Order):
        self.k, self.keys = k, [(c, "descending" if down else "ascending") for c, down in order]
        self.held: list[pa.Table] = []
        self.rows = 0

    def take(self, batch: pa.RecordBatch | pa.Table) -> None:
        table = batch if isinstance(batch, pa.Table) else pa.Table.from_batches([batch])
        self.held.append(table)
        self.rows += table.num_rows
        if self.rows >= 2 * self.k + 1024:
            self.held = [self.best()]
            self.rows = self.held[0].num_rows

    def best(self) -> pa.Table:
        table = pa.concat_tables(self.held)
        return table.take(pc.sort_indices(table, sort_keys=self.keys, null_placement="at_end")[: self.k])


def top_k(df: DataFrame, k: int, order: Order) -> DataFrame:
    """The first ``k`` rows in an order of (column, descending) pairs; nulls come last either way."""
    if k < 1:
        return df.limit(0)

    def run(batches):
        best = Bounded(k, order)
        for b in batches:
            if b.num_rows:
                best.take(b)
        if best.held:
            yield from best.best().to_batches()

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.mapInArrow(run, df.schema)
    for n in (math.isqrt(parts), 1):
        if n < parts:
            out = out.repartition(n).mapInArrow(run, df.schema)
    return out


def head(df: DataFrame, k: int, by: list[str], order: list[Column], place: str = "place") -> DataFrame:
    """The first ``k`` rows of each group with their place in it. Spark cuts groups down to ``k``
    rows before it shuffles them, so that a hot group isn't gathered."""
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(place) <= k)

"""Connected components over an edge table, with DataFrame operations alone.

Each node points at the smallest of its neighbours, if that is smaller than itself; one
aggregation with partial sums gives the pointers. Pointers lead to ever smaller nodes,
so they form trees, whose roots are found by replacing pointers by those of their
targets: paths shorten by half a time. Then the edges are taken between roots, most
fall within a tree and go, and the same is done with what is left; at least half of the
nodes go each time. So all edges are joined once, and ever fewer after that. Both sides
of each join are written tables, so a hub that holds a third of all edges is split by
the skew join. Nothing is collected but a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialise


def rooted(pointers: DataFrame) -> DataFrame:
    """(node, parent) with every pointer at the root of its tree."""
    while True:
        up = pointers.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
        jumped = materialise(pointers.join(up, "parent").select("node", F.col("up").alias("parent"), (F.col("up") != F.col("parent")).alias("moved")), "pointers")
        discard(pointers)
        pointers = jumped.select("node", "parent")
        if not jumped.where("moved").limit(1).count():
            return pointers


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node reachable.

    Nulls and loops are dropped, repeated edges count once; no edges give no rows.
    """
    between = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    e = materialise(edges.where("a is not null and b is not null and a <> b").select(*between("a", "b")).distinct(), "edges")
    levels = []
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointers = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("parent")), "pointers")
        levels.append(rooted(pointers))
        of = lambda c: levels[-1].select(F.col("node").alias(c), F.col("parent").alias(f"{c}_root"))  # noqa: B023, E731
        half = materialise(e.join(of("a"), "a").select("a_root", "b"), "edges")
        rest = materialise(half.join(of("b"), "b").where("a_root <> b_root").select(*between("a_root", "b_root")).distinct(), "edges")
        discard(e, half)
        e = rest
        if not e.limit(1).count():
            break
    found = levels.pop().withColumnRenamed("parent", "component")
    while levels:
        last = found.select(F.col("node").alias("parent"), "component")
        found = materialise(levels.pop().join(last, "parent", "left").select("node", F.coalesce("component", "parent").alias("component")), "components")
    return found

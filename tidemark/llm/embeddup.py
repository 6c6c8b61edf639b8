"""Embedding near-duplicates by an epsilon grid order join.

Vectors of one length and unit norm lie within eps = sqrt(2 - 2 cos) of each other if
their cosine is at least ``least``. They are rotated onto leading principal directions
(fitted on a bounded sample; the rotation only serves pruning), ordered by the cells
of a grid of width eps on those, and cut into sequence intervals of ``block`` vectors.
Interval pairs are joined recursively: a pair whose bounding boxes are over eps apart
is dropped with all that is below it. What is left are pairs of blocks, whose cosines
one matrix product in double precision gives.

Equal vectors are one entry with a count, however many rows hold them. A task of the
last step holds two blocks, read from the shared folder; it returns a count for each
vector that has links and edges of a spanning forest, never the pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
link with nothing; vectors of different lengths don't link; a null vec_id takes part but
names a class only if all its members' ids are null, and is kept only then; repeated
rows are vectors of their own; an empty table gives no rows; only vec_id and embedding are
read, other columns may have any name.

What skipping saves depends on the data. A box is skipped if it lies eps away on the
leading directions. At a cosine of 0.95 eps is 0.316, while vectors spread evenly over 64
dimensions reach over about 0.8 on each direction: then nearly all blocks touch, and work
grows with the square of the rows. Clustered or longer tables skip more.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import filesystem, materialise, work_path
from tidemark.llm.components import components

#: Rounding that the pruning allows for.
SLACK = 1e-6


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of unit norm, scaled first so that no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def valid(col: str):
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.coalesce(F.col(col).isNotNull() & (F.size(col) > 0) & F.forall(col, finite) & F.exists(col, lambda v: v != 0), F.lit(False))


def directions(entries: DataFrame, dims: int, sample: int) -> dict[int, np.ndarray]:
    """Leading principal directions for each vector length, of at most ``sample`` vectors in all."""
    picked = entries.select("v").orderBy(F.xxhash64("v"), "v").limit(sample).collect()
    by: dict[int, list] = {}
    for r in picked:
        by.setdefault(len(r.v), []).append(r.v)
    out = {}
    for n, rows in by.items():
        x = unit(np.array(rows, float))
        out[n] = np.linalg.eigh(np.cov(x.T).reshape(n, n) if len(x) > 1 else np.eye(n))[1][:, ::-1][:, :dims].copy()
    return out


def ordered(entries: DataFrame, eps: float, dims: int, sample: int) -> DataFrame:
    """Entries with their projection p and grid cell g."""
    axes = directions(entries, dims, sample)

    def run(batches):
        for b in batches:
            vs = b.column("v").to_pylist()
            sizes = np.array([len(v) for v in vs])
            p: list = [None] * len(vs)
            for n in set(sizes.tolist()):
                at = np.flatnonzero(sizes == n)
                x = unit(np.array([vs[i] for i in at], float))
                q = x @ axes[n] if n in axes else x[:, :dims]  # any fixed rotation's part bounds the distance
                for i, row in zip(at.tolist(), q.tolist(), strict=True):
                    p[i] = row
            g = [np.floor(np.array(q) / eps).astype(int).tolist() for q in p]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.list_(pa.float64())), pa.array(g, pa.list_(pa.int32()))], names=[*b.schema.names, "p", "g"])

    return entries.mapInArrow(run, "v array<double>, n long, least long, p array<double>, g array<int>")


def blocks(entries: DataFrame, block: int, folder: str) -> DataFrame:
    """Sequence intervals: seq (range partition, number in it), length, box; vectors go to files.

    Each file holds the vectors of one block; its entries are numbered from first on.
    """
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    size = F.size("v")
    rows = entries.select("v", "p", "n", "least", size.alias("d"), "g").repartitionByRange("d", "g", "p", "v").sortWithinPartitions("d", "g", "p", "v")

    def run(batches):
        import uuid

        from pyspark import TaskContext

        fs, root = filesystem(folder)
        pid, k, held, name = TaskContext.get().partitionId(), 0, [], uuid.uuid4().hex

        def close():
            nonlocal k, held
            d, p = held[0][4], np.array([h[1] for h in held])
            buf = io.BytesIO()
            np.savez(buf, v=np.array([h[0] for h in held], float), n=np.array([h[2] for h in held], np.int64))
            with fs.open_output_stream(f"{root}/{pid}-{k}-{name}") as f:
                f.write(buf.getvalue())
            out = pa.RecordBatch.from_pydict({"pid": [pid], "k": [k], "d": pa.array([d], pa.int32()), "file": [f"{pid}-{k}-{name}"], "lo": [p.min(0).tolist()], "hi": [p.max(0).tolist()], "entries": pa.array([[{"v": h[0], "n": h[2], "least": h[3]} for h in held]], pa.list_(pa.struct([("v", pa.list_(pa.float64())), ("n", pa.int64()), ("least", pa.int64())])))})
            k, held = k + 1, []
            return out

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (len(held) >= block or held[0][4] != r[4]):
                    yield close()
                held.append(r)
        if held:
            yield close()

    return rows.mapInArrow(run, "pid long, k long, d int, file string, lo array<double>, hi array<double>, entries array<struct<v:array<double>,n:long,least:long>>")


def near(eps: float):
    """Whether the boxes of columns a and b come within eps."""
    gaps = F.zip_with(F.zip_with("a.lo", "b.hi", lambda x, y: x - y), F.zip_with("b.lo", "a.hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= (eps + SLACK) ** 2


def close_pairs(index: DataFrame, eps: float, fan: int = 16) -> DataFrame:
    """Pairs (a, b) of block numbers, a <= b, whose boxes come within eps.

    Levels of intervals of fan**l blocks are joined from the top: each surviving pair
    opens into its children's pairs, which meet their boxes by equality joins.
    """
    count = index.count()
    levels = 0
    while fan**levels < count:
        levels += 1
    pairs = index.sparkSession.createDataFrame([(0, 0)] if count else [], "x long, y long")
    for level in range(levels - 1, -1, -1):
        width = fan**level
        dims = F.min(F.size("lo"))
        boxes = index.groupBy(F.floor(F.col("id") / width).cast("long").alias("i")).agg(
            dims.alias("m"), *[F.min(F.get("lo", F.lit(j))).alias(f"l{j}") for j in range(DIMS)], *[F.max(F.get("hi", F.lit(j))).alias(f"h{j}") for j in range(DIMS)]
        )
        part = lambda c: F.filter(F.array(*[F.col(f"{c}{j}") for j in range(DIMS)]), lambda v: v.isNotNull())
        boxes = materialise(boxes.select("i", F.slice(part("l"), 1, F.col("m")).alias("lo"), F.slice(part("h"), 1, F.col("m")).alias("hi")), "interval-boxes")
        step = lambda c: F.explode(F.sequence(F.col(c) * fan, F.col(c) * fan + fan - 1))
        opened = pairs.select(step("x").alias("x"), "y").select("x", step("y").alias("y")).where("x <= y")
        a = boxes.select(F.col("i").alias("x"), F.struct("lo", "hi").alias("a"))
        b = boxes.select(F.col("i").alias("y"), F.struct("lo", "hi").alias("b"))
        pairs = materialise(opened.join(a, "x").join(b, "y").where(near(eps)).select("x", "y"), "interval-pairs")
    return pairs


#: Leading principal directions of the grid.
DIMS = 12


def joined(pairs: DataFrame, folder: str, least: float) -> DataFrame:
    """For block pairs (x, xf, y, yf): rows (id, n, other): n rows linked to entry id, or an edge to other."""

    def load(fs, root, name):
        with fs.open_input_file(f"{root}/{name}") as f:
            z = np.load(io.BytesIO(f.read()))
            return unit(z["v"]), z["n"]

    def run(batches):
        fs, root = filesystem(folder)
        for batch in batches:
            for x, xf, y, yf in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (u, n), (w, m) = load(fs, root, xf), load(fs, root, yf)
                if u.shape[1] != w.shape[1]:
                    continue
                hit = u @ w.T >= least
                if x == y:
                    np.fill_diagonal(hit, False)
                ids, counts, other = [], [], []
                for base, c in ((x, hit @ m), (y, hit.T @ n))[: 1 if x == y else 2]:
                    at = np.flatnonzero(c)
                    ids += (base * BLOCK_SPAN + at).tolist()
                    counts += c[at].tolist()
                    other += [None] * len(at)
                a, b = np.nonzero(hit)
                for s, t in forest(a, b + (0 if x == y else len(u)), len(u) + len(w)):
                    ids.append(x * BLOCK_SPAN + s)
                    counts.append(None)
                    other.append(x * BLOCK_SPAN + t if x == y else y * BLOCK_SPAN + t - len(u))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(other, pa.int64())], names=["id", "n", "other"])

    return pairs.select("x", "xf", "y", "yf").mapInArrow(run, "id long, n long, other long")


#: Entries of block k are numbered from k * BLOCK_SPAN on.
BLOCK_SPAN = 1 << 20


def forest(a: np.ndarray, b: np.ndarray, n: int):
    """Edges (from ``a`` to ``b``) of a spanning forest of the given ones."""
    up = list(range(n))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    # each row's first partner, then the others, whose number shrinks as rows join
    for s, t in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(s), top(t)
        if p != q:
            up[max(p, q)] = min(p, q)
            yield s, t


def links(entries: DataFrame, least: float = 0.95, block: int = 1024, sample: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Entries (id, v, n, least) and what joined() gives for all their block pairs."""
    spark, eps = entries.sparkSession, max(1e-6, float(np.sqrt(max(0.0, 2 - 2 * least))))
    folder = work_path(spark, "embedding-blocks")
    cut = materialise(blocks(ordered(entries, eps, DIMS, sample), block, folder), "blocks")
    # number the blocks: partitions' counts are summed in order, one row a partition
    sizes = cut.groupBy("pid").agg(F.count(F.lit(1)).alias("c"))
    base = sizes.select("pid", (F.sum("c").over(Window.orderBy("pid")) - F.col("c")).alias("base"))
    numbered = materialise(cut.join(base, "pid").withColumn("id", F.col("base") + F.col("k")), "numbered-blocks")
    index = numbered.select("id", "file", "lo", "hi")
    pairs = close_pairs(index, eps)
    x = index.select(F.col("id").alias("x"), F.col("file").alias("xf"))
    y = index.select(F.col("id").alias("y"), F.col("file").alias("yf"))
    todo = pairs.join(x, "x").join(y, "y").repartition(spark.sparkContext.defaultParallelism * 4)
    found = materialise(joined(todo, folder, least), "embedding-links")
    listed = numbered.select("id", F.posexplode("entries").alias("i", "e")).select((F.col("id") * BLOCK_SPAN + F.col("i")).alias("id"), "e.*")
    return listed, found


def near_duplicates(embeddings: DataFrame, least: float = 0.95, block: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).withColumn("ok", valid("v"))
    entries = materialise(rows.where("ok").groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least")), "distinct-vectors")
    listed, found = links(entries, least, block)
    others = found.where("n is not null").groupBy("id").agg(F.sum("n").alias("others"))
    comp = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "id")
    joinedup = materialise(listed.join(others, "id", "left").join(comp, "id", "left").select("id", "v", "least", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component")), "vector-links")
    names = materialise(joinedup.groupBy("component").agg(F.min("least").alias("component_id")), "vector-components")
    known = materialise(joinedup.join(names, "component").select("v", "n_links", "component_id"), "vector-labels")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.where("ok").join(known, "v").select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

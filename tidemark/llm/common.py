"""Shared folders, materialised tables and file access used by the operators."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset on a single machine (tests) a temporary folder is made once and set
    as the checkpoint folder; on a cluster that folder would be each machine's own, so it
    is an error there.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def work_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut and
    a lost executor costs a reread, not a recomputation."""
    spark, path = df.sparkSession, work_path(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing will read again."""
    for df in tables:
        spark, files = df.sparkSession, df.inputFiles()
        if files:
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """Within it, Spark deletes the shuffle files of each query that has ended, as the tables written here need
    them no longer; else they stay until the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_batches(docs: DataFrame, rows: int = 1000) -> DataFrame:
    """``docs``, after bounding the rows of the batches that go to Python in this session:
    Spark's 10,000 whole texts at once are more than a worker needs to hold."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return docs


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; plain and ``file:`` paths are local or mounted."""
    if uri.startswith("file:"):
        path = uri[5:]
        return pafs.LocalFileSystem(), "/" + path.lstrip("/")
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def slices_of(batch: pa.RecordBatch, column: int, most: int = 1_000_000):
    """Consecutive slices of a batch with about ``most`` bytes of text; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for group in groups_of(list(enumerate(sizes)), lambda x: x[1], most):
        yield batch.slice(group[0][0], len(group))


def groups_of(items: list, size, most: int):
    """Consecutive slices of ``items`` whose sizes sum to about ``most``; a larger item is alone."""
    part, total = [], 0
    for x in items:
        n = size(x)
        if part and total + n > most:
            yield part
            part, total = [], 0
        part.append(x)
        total += n
    if part:
        yield part

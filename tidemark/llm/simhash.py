"""SimHash fingerprints and their links by deletion variants.

Fingerprints (64 bits) that differ in two bits or fewer, cut into two segments, have
a segment in which they differ by at most one bit. Each distinct fingerprint is
indexed under every segment with one bit wild; fingerprints that meet under a key are
candidates and the bits are counted to verify them. Keys are counted first; of the
entries, only those that a bitmap of the shared keys lets through are shuffled again.

The hot-key path: a key that holds over ``most`` distinct fingerprints (a cloud of near
copies) isn't paired up. Its fingerprints go a way that is exact without pairs: each is
filed under itself and its 64 neighbours at one bit, and all that meet at such a centre
(65 at most) link to the smallest there. Any two at two bits or fewer share a centre and
any two that share one are that close, so no component changes and rows stay linear.

Equal fingerprints are one node however many documents hold them.

Defined cases: null, empty and wordless texts have fingerprint zero and link like any
other; rows with a null doc_id are kept and take part, but name no component unless
the component has no other id; repeated rows are kept; texts of any length are hashed
whole, in chunks; an empty table gives no rows; other columns may have any name, only
doc_id and text are read (one_of_each carries them in a struct).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from tidemark.llm.common import materialise, small_batches
from tidemark.llm.components import components
from tidemark.llm.substrings import bitmap, in_bitmap

SEED = 42
#: Links differ in so many bits at most: two segments, and centres of one bit, serve just that.
BITS = 2
#: Spreads the slots over the bits of a bitmap.
_SPREAD = 2654435761


def fingerprint(text: str | None, shingle: int = 3, chunk: int = 1 << 16) -> int:
    """Majority bits of the shingles' XXH64; a tie gives 0."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
    ends = (starts + lens - 1)[k - 1 :]
    starts, h = starts[: len(ends)], xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for i in range(0, len(ends), chunk):
        a, b = starts[i : i + chunk].tolist(), ends[i : i + chunk].tolist()
        hashes = np.array([h(joined[x:y], SEED) for x, y in zip(a, b, strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(ends), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every whole text."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _keys():
    """Every segment with one bit wild: segment and bit name the slot, the rest is the value."""
    n, keys = BITS // 2 + 1, []
    for s in range(n):
        low, width = 64 // n * s, 64 // n
        for pos in range(width):
            value = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << pos)))
            keys.append(F.struct(F.lit(s * 64 + pos).cast("short").alias("slot"), value.alias("value")))
    return F.array(*keys)


def _entries_among(fps: DataFrame, keys: DataFrame, bits: int = 26) -> DataFrame:
    """fp, slot, value of the entries under ``keys``, and a few others.

    A bitmap of fixed size keeps most entries that are alone under their key out of the
    shuffle; the join with the keys decides.
    """
    sent = fps.sparkSession.sparkContext.broadcast(bitmap(keys.select(F.col("value").bitwiseXOR(F.col("slot").cast("long") * F.lit(_SPREAD)).alias("hash")), bits))
    n, width = BITS // 2 + 1, 64 // (BITS // 2 + 1)

    def run(batches):
        known = sent.value
        for b in batches:
            fp, cols = b.column(0).to_numpy().view(np.uint64), ([], [], [])
            for s in range(n):
                part = (fp >> np.uint64(width * s)) & np.uint64((1 << width) - 1)
                for pos in range(width):
                    value, slot = part & np.uint64(((1 << width) - 1) & ~(1 << pos)), s * 64 + pos
                    at = np.flatnonzero(in_bitmap(known, value ^ np.uint64(slot * _SPREAD)))
                    for col, x in zip(cols, (fp[at].view(np.int64), np.full(len(at), slot, np.int16), value[at].view(np.int64)), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["fp", "slot", "value"])

    return fps.mapInArrow(run, "fp long, slot short, value long")


def _centres():
    """The fingerprint and all its neighbours at one bit."""
    return F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)])


def links(fps: DataFrame, most: int = 32) -> DataFrame:
    """Edges (a, b), each of two bits or fewer, that connect all distinct ``fp`` which such links connect."""
    # a task or two would read the few MB of distinct fingerprints, and each makes 64 entries
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = materialise(fps.select("fp").distinct(), "simhash-distinct")
    spread = distinct.repartition(n, "fp")
    entries = spread.select(F.explode(_keys()).alias("key")).select("key.slot", "key.value")
    # counted with partial sums and joined back, so a key that holds a large part of all rows is split
    keys = materialise(entries.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-keys")
    shared = materialise(_entries_among(spread, keys).join(keys, ["slot", "value"]), "simhash-shared")
    few = shared.where(F.col("n") <= most).select("slot", "value", "fp")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS
    pairs = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), ["slot", "value"]).where((F.col("a") < F.col("b")) & close)
    filed = shared.where(F.col("n") > most).select("fp").distinct().select("fp", F.explode(_centres()).alias("centre"))
    stars = filed.withColumn("a", F.min("fp").over(Window.partitionBy("centre"))).where("a < fp").withColumnRenamed("fp", "b").where(close)
    return pairs.select("a", "b").unionByName(stars.select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links, itself included)."""
    found = materialise(fingerprints(docs, shingle), "fingerprints")
    comp = components(links(found))
    own = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = own.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "least")
    named = materialise(named, "fingerprint-components")
    least = materialise(named.groupBy("component").agg(F.min("least").alias("component_id")), "component-ids")
    labels = materialise(named.join(least, "component").select("fp", "component_id"), "fingerprint-labels")
    return found.join(labels, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(docs: DataFrame, shingle: int = 3, most_broadcast: int = 1_000_000) -> DataFrame:
    """The rows of docs, all columns as they are, without near duplicates.

    Of each component the row with the smallest doc_id stays (a null id is last; of equal
    ids one row stays). The rows that go are told by a row number that is written with
    the rows; if they are few, they go to all tasks, else both sides are shuffled.
    """
    packed = small_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    kind = StructType([packed.schema["row"], StructField("fp", LongType())])

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["row", "fp"])

    rows = materialise(packed.mapInArrow(run, kind).withColumn("number", F.monotonically_increasing_id()), "fingerprinted")
    found = rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), "number", "fp")
    comp = components(links(found)).withColumnRenamed("node", "fp")
    first = found.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "number")).alias("first"))
    named = materialise(first.join(comp, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component")), "fingerprint-components")
    kept = named.groupBy("component").agg(F.min("first").alias("kept"))
    stay = materialise(named.join(materialise(kept, "kept"), "component").select("fp", F.col("kept.number").alias("stays")), "fingerprint-keepers")
    gone = materialise(found.join(stay, "fp").where("number <> stays").select("number"), "near-duplicates")
    few = gone.count() <= most_broadcast
    return rows.join(F.broadcast(gone) if few else gone, "number", "left_anti").select("row.*")

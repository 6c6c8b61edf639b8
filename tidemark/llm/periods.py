"""Runs: stretches of words that repeat with a period, and texts without the repeats.

A run is a stretch of consecutive words whose smallest period is q (words q apart are
equal), of at least ``max(least, times * q)`` words, that no neighbouring word extends.
The word numbers of the texts in a batch lie in one array; for every lag up to a
``times``-th of the longest text the array is compared with itself moved by that lag, and
stretches of equal words that are long enough are the runs. The comparison looks at every
s-th word first, with s such that a stretch holds four of these at least, and at all words
only around four equal ones in a row; so a lag costs its share of the words, not all.

Texts of at least ``LONG`` characters are cut into ranges of lags that Spark deals over
the cluster, 32 for a text at most; what the ranges find is merged by place: the smallest
period of a place is its run. All other texts are scanned where they are read, no shuffle.

Defined cases: null, empty and blank texts have no words and no runs; texts of any length
are taken whole; repeated rows and ids give a row each; an empty table gives no rows; a
null id is kept; of other columns only ``carry`` is kept, those with clashing names aside.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices_of, small_batches

LEAST, TIMES = 24, 3
LONG = 1 << 16
RANGES, WIDTH = 32, 4096
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
FOUND = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(known.__getitem__, words), np.int32, len(words))


def stretches(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Start and end of stretches of at least ``least`` true values."""
    edges = np.flatnonzero(np.diff(same, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    keep = ends - starts >= least
    return list(zip(starts[keep].tolist(), ends[keep].tolist(), strict=True))


def scan(texts: list[np.ndarray], least: int = LEAST, times: int = TIMES, lags: tuple[int, int] | None = None) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each numbered text by start and period, over the lags in [from, to)."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    firsts = np.cumsum(sizes + 1) - sizes - 1
    flat = np.empty(int(sizes.sum()) + len(order), np.int32)
    for k, i in enumerate(order):
        flat[firsts[k] : firsts[k] + sizes[k]] = texts[i]
        flat[firsts[k] + sizes[k]] = -1 - k  # equal to nothing, so that no stretch leaves its text
    longest = int(sizes[-1]) // times if len(order) else 0
    lo, hi = (1, longest + 1) if lags is None else (max(1, lags[0]), min(longest + 1, lags[1]))
    takes_part = np.searchsorted(sizes, np.arange(lo, max(lo, hi)) * times)  # the first text that is long enough
    found: list[dict[tuple[int, int], int]] = [{} for _ in order]
    for q in range(lo, hi):
        first, end = int(firsts[takes_part[q - lo]]), len(flat) - q
        need = max(least - q, (times - 1) * q, 1)
        step = max(1, need // 4)
        same = flat[first:end:step] == flat[first + q :: step]
        if need < 4:
            row, hits = 1, np.flatnonzero(same)
        elif len(same) < 4:
            continue
        else:  # four of the compared words in a row lie in any stretch
            row, hits = 4, np.flatnonzero(same[:-3] & same[1:-2] & same[2:-1] & same[3:])
        if not len(hits):
            continue
        breaks = np.flatnonzero(np.diff(hits) > 1) + 1
        for a, b in zip(hits[np.r_[0, breaks]].tolist(), hits[np.r_[breaks - 1, len(hits) - 1]].tolist(), strict=True):
            at, stop = first + a * step, first + (b + row - 1) * step
            k = int(np.searchsorted(firsts, at, "right")) - 1
            here = int(firsts[k])
            # a multiple of a period has the same run: no need to compare it again
            if any(q % p == 0 and s + here <= at and stop + q < s + here + n for (s, n), p in islice(found[k].items(), 8)):
                continue
            # the compared words before and after these differ, or the array ends
            at, stop = max(first, at - step + 1), min(end, stop + step)
            for s, e in stretches(flat[at:stop] == flat[at + q : stop + q], need):
                k = int(np.searchsorted(firsts, at + s, "right")) - 1
                found[k].setdefault((at + s - int(firsts[k]), e - s + q), q)  # multiples of a period come later
    out: list[list[tuple[int, int, int]]] = [[] for _ in order]
    for k, i in enumerate(order):
        out[i] = sorted(((s, n, q) for (s, n), q in found[k].items()), key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats, joined by one space: of a run its first period stays."""
    if runs:
        depth = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            depth[start + period] += 1
            depth[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
    return b" ".join(words)


def _words(texts: pa.Array) -> list[list[bytes]]:
    return [(t or b"").split() for t in pc.cast(texts, pa.binary()).to_pylist()]


def _rows(part: pa.RecordBatch, words: list[list[bytes]], runs: list) -> pa.RecordBatch:
    names = part.schema.names
    kept = [(n, part.column(i)) for i, n in enumerate(names) if n not in ("_text", "_runs")]
    listed = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], FOUND)
    texts = pc.cast(pa.array([collapsed(w, r) for w, r in zip(words, runs, strict=True)], pa.binary()), pa.string())
    return pa.RecordBatch.from_arrays([c for _, c in kept] + [pa.array(map(len, words), pa.int64()), listed, texts], names=[n for n, _ in kept] + ["n_words", "runs", "collapsed"])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES, carry: tuple[str, ...] = (), long: int = LONG) -> DataFrame:
    """The id (and ``carry``), n_words, runs by start and period, and the collapsed text of each row."""
    if least < 1 or times < 2:
        raise ValueError("a run has at least one word and repeats at least twice")
    if {*carry, id_col} & {"n_words", "runs", "collapsed", "_text", "_runs"}:
        raise ValueError("rename carried columns that clash with results")
    keep = list(dict.fromkeys((id_col, *carry)))
    rows = small_batches(docs).select(*keep, F.col(text_col).alias("_text"))
    fields = [rows.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", n_words long, runs {RUNS}, collapsed string"
    at = len(keep)

    def whole(batches):
        for batch in batches:
            for part in slices_of(batch, at, 4_000_000):
                words = _words(part.column(at))
                yield _rows(part, words, scan([numbered(w) for w in words], least, times))

    def ranged(batches):
        for batch in batches:
            for key, lo, hi, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                runs = scan([numbered(text.encode().split())], least, times, (lo, hi))[0]
                yield pa.RecordBatch.from_pydict({"_key": pa.array([key] * len(runs), pa.string())} | {n: pa.array([r[i] for r in runs], pa.int64()) for i, n in enumerate(("start", "length", "period"))})

    def merged(batches):
        for batch in batches:
            for part in slices_of(batch, at, 4_000_000):
                words = _words(part.column(at))
                runs = [[(r["start"], r["length"], r["period"]) for r in x or ()] for x in part.column(at + 1).to_pylist()]
                yield _rows(part, words, runs)

    is_long = F.coalesce(F.length("_text") >= long, F.lit(False))
    short = rows.filter(~is_long).mapInArrow(whole, schema)
    key = F.sha2(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(" "), F.col("_text")), 256)
    texts = rows.filter(is_long).withColumn("_key", key)
    # no more words than every second character, no lag beyond a times-th of those
    lags = F.floor((F.length("_text") + 1) / (2 * times)) + 1
    width = F.greatest(F.lit(WIDTH), F.ceil(lags / RANGES))
    ranges = texts.select("_key", F.explode(F.sequence(F.lit(1), lags, width)).alias("lo"), width.alias("width"), "_text").select("_key", "lo", (F.col("lo") + F.col("width")).alias("hi"), "_text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = ranges.repartition(parts, "_key", "lo").mapInArrow(ranged, "_key string, start long, length long, period long")
    runs = places.groupBy("_key", "start", "length").agg(F.min("period").alias("period"))
    runs = runs.groupBy("_key").agg(F.expr("array_sort(collect_list(struct(start, period, length)))").alias("r"))
    runs = runs.select("_key", F.expr("transform(r, x -> named_struct('start', x.start, 'length', x.length, 'period', x.period))").alias("_runs"))
    return short.unionByName(texts.join(runs, "_key", "left").select(*keep, "_text", "_runs").mapInArrow(merged, schema))


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text; of every tenth id, by the CRC-32 of its decimal digits, the words
    from some place on are repeated with some period instead. A null id's text stays as it is."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.crc32(F.col(id_col).cast("string").cast("binary")).alias("_h"))
    chosen = (F.col("_h") % 10 == 0) & F.col("text").isNotNull()
    rows = rows.withColumn("_w", F.when(chosen, F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')")))
    rows = rows.withColumn("_n", F.size("_w").cast("long")).withColumn("_g", F.expr("_h div 10"))
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, F.expr("cast(_g % _n as int)"))).withColumn("_p", F.expr("cast(1 + (_n - _a) div (3 + _g % 8) as int)"))
    again = F.expr("array_join(concat(slice(_w, 1, _a), slice(flatten(array_repeat(slice(_w, _a + 1, _p), cast(ceil((_n - _a) / _p) as int))), 1, cast(_n - _a as int))), ' ')")
    return rows.select("doc_id", F.when(F.col("_a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Of each row of ``find``: the number of runs, the run of the greatest exact length over
    period (ties: smallest start, then period) and digests of the runs and of the collapsed text."""
    better = "array_sort(runs, (x, y) -> cast(coalesce(nullif(sign(y.length * x.period - x.length * y.period), 0), nullif(sign(x.start - y.start), 0), sign(x.period - y.period)) as int))"
    top = found.withColumn("_top", F.when(F.size("runs") > 0, F.expr(f"({better})[0]")))
    listed = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"_top.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * _top.length div _top.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

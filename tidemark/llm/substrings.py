"""Repeated passages by collinear chaining of shared k-mers.

Texts become words (runs of letters, digits and non-ASCII, A-Z in lower case). Of the
hashes of all runs of ``K`` words, the smallest in each window of ``W`` are seeds, so any
unedited stretch of K + W - 1 words gives one. Seeds are counted over all texts; each
place of a seed that several texts hold is written with the hash of the ``FLANK`` words on
both sides of it and a signature (``BANDS`` minima of hashed word pairs) of ``SIDE`` words
on each side. Sorted by seed and context, places meet others of their seed:

- up to ``CROWD`` places: all of them meet;
- beyond that, those with the same exact context meet the one of least key among them, so
  the texts that hold a passage word for word form a star; the centres of these stars do
  the same with those that agree in half a signature, and one that agrees with none meets
  its neighbour in the order of the whole signature.

Stars of different seeds of a passage mostly have the same centre, so a text has few
partners. Two places are a match if their exact contexts are equal or bands of a signature
are. That is linear in the places, and leaves pairs out; all those of crowded seeds that can
lie in a passage are looked for in a second pass (``crowded_matches``) and aligned as well. A seed with a large part of all places (``hot``) is
sorted over many tasks, and the stars are joined again where two tasks meet.

For each pair of texts, matches are chained: a tree of maxima over the other text's
positions gives the best chain that ends before a match and within the gap in both texts,
less a cost for the words skipped. Chains whose equal contexts alone make up a passage are
settled by their hashes, and only their ends are looked at; all others are aligned word by
word between their seeds and beyond their ends. Stretches of ``LEAST`` words or more with
``SHARE`` of them equal are passages. The words come to the pairs in tiles of ``TILE`` words,
so no pair draws in more of a long text than it needs.

Defined cases: null texts and texts of fewer words than LEAST hold no passage; a passage
that repeats only within one text isn't reported; rows with a null doc_id count as
holders of their text and are reported; repeated rows and equal texts are copies of each
other; texts of any length are taken whole; an empty table gives no rows; other columns may
have any name, only doc_id and text are read. Texts are told apart by 64 bits of hash: among
2e10 different texts about ten pairs are expected to be taken for equal.
"""

from __future__ import annotations

import itertools
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialise, shuffles_freed, slices_of, small_batches
from tidemark.llm.components import components
from tidemark.llm.decontam import blanked

K, W = 4, 5
LEAST, SHARE = 50, 0.8
TILE = 64
#: Words that may be skipped in either text within one chain, and the cost of each.
GAP, COST = 40, 0.1
MARGIN = LEAST
#: Words of exact context on each side of a seed. A passage of LEAST words holds a seed with both.
FLANK = 16
#: A seed in a passage has this many of its words on one side at least.
SIDE = (LEAST - K) // 2
#: Parts of the signature of a side, of 8 bits each.
BANDS = 4
#: Places of a seed of which all pairs are taken; beyond that, stars of like contexts.
CROWD = 16
#: Equal bands that a chain has over all its matches at least; equal exact contexts count as so many.
LIKE, EXACT = 2, 2 * BANDS + 1
#: Places that a task holds at once.
BLOCK = 1 << 16
#: Keys of texts that a task remembers in order to write copies once.
MOST_KEYS = 500_000

_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def slide(x: np.ndarray, n: int, f) -> np.ndarray:
    """f (minimum or maximum) over each window of n."""
    size = 1
    while 2 * size <= n:
        x = f(x[:-size], x[size:])
        size *= 2
    rest = n - size
    return f(x[: len(x) - rest], x[rest:]) if rest else x


def runs(x: np.ndarray, n: int) -> np.ndarray:
    """A polynomial hash of each run of n, from those of halves."""
    size, h, done, out = 1, x, 0, x[:0]
    while True:
        base = np.uint64(pow(int(_BASE), size, 1 << 64))
        if n & size:  # the run so far, then this power of two
            out = out[: len(x) - done - size + 1] * base + h[done : len(x) - size + 1] if done else h
            done += size
        if done == n:
            return out
        h = h[:-size] * base + h[size:]
        size *= 2


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return (x ^ (x >> np.uint64(32))) * _MIX


class Powers:
    """Powers of the byte base and of its inverse, as many as were asked for so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            base = int(_MIX)
            grow = lambda b: np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, b, np.uint64))))
            self.up, self.down = grow(base), grow(pow(base, -1, 1 << 64))
        return self.up[:n], self.down[:n]


powers = Powers()
#: Bytes whose words are hashed at once; a longer word is taken whole.
CHUNK = 1 << 20


def words_in(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of blanked text: sums of bytes times powers of a base, from prefix sums."""
    hashes, starts, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(data):
        end = len(data) if len(data) - at <= CHUNK else data.find(b" ", at + CHUNK)
        end = len(data) if end < 0 else end
        x = np.frombuffer(data, np.uint8, end - at, at)
        edge = np.flatnonzero(np.diff((x != 0x20).astype(np.int8), prepend=0, append=0))
        s, e = edge[::2], edge[1::2]
        up, down = powers(len(x) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * up[:-1], dtype=np.uint64)))
        hashes.append(mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _BASE))
        starts.append(s + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def key_of(hashes: np.ndarray) -> int:
    x = xxhash.xxh3_64_intdigest(hashes.tobytes(), 7)
    return x - (1 << 64) if x >> 63 else x


def text_key(words: list[bytes]) -> int:
    return key_of(words_in(b" ".join(words))[0])


class Texts:
    """Hashes of the words of blanked texts on end, each with empty places around it; texts of
    fewer than ``least`` words are left out."""

    def __init__(self, texts: list[bytes], least: int = 1):
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        hashes, starts = words_in(b" ".join(texts))
        text = np.searchsorted(ends, starts, "right")
        size = np.bincount(text, minlength=len(texts))
        held = size >= least
        self.rows = np.flatnonzero(held)  # numbers among the texts given
        self.size = size[held]
        hashes = hashes[held[text]]
        before = np.cumsum(self.size) - self.size
        self.first = before + (np.arange(len(self.rows)) + 1) * W
        self.hash = np.zeros(len(hashes) + (len(self.rows) + 1) * W, np.uint64)
        self.hash[np.arange(len(hashes)) + np.repeat(self.first - before, self.size)] = hashes
        self.keys = [key_of(hashes[a : a + n]) for a, n in zip(before.tolist(), self.size.tolist(), strict=True)]

    def words(self, i: int) -> np.ndarray:
        return self.hash[self.first[i] : self.first[i] + self.size[i]]

    def seeds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, text and place on end of every seed, by place."""
        step = np.zeros(len(self.hash) + 1, np.int8)
        step[self.first] += 1
        step[self.first + self.size - K + 1] -= 1
        whole = np.cumsum(step[: len(self.hash) - K + 1]).astype(bool)
        h = np.where(whole, mixed(runs(self.hash, K)), _NONE)
        edge = np.zeros(W - 1, np.uint64)
        high = slide(np.concatenate((edge, slide(h, W, np.minimum), edge)), W, np.maximum)
        at = np.flatnonzero((high == h) & whole)  # it is the smallest of some window that holds it
        return h[at], np.searchsorted(self.first, at, "right") - 1, at

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The seeds, but of a seed that comes again and again within its context only the first and the last."""
        h, text, at = self.seeds()
        order = np.lexsort((at, h, text))
        near = (text[order][1:] == text[order][:-1]) & (h[order][1:] == h[order][:-1]) & (np.diff(at[order]) < K + 2 * FLANK)
        inner = np.zeros(len(at), bool)
        inner[order[1:-1]] = near[:-1] & near[1:]
        return h[~inner], text[~inner], at[~inner]

    def contexts(self, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For seeds: hash of the exact context, signatures of the words before and behind; 0 where the text ends first."""
        start, end = self.first[text], self.first[text] + self.size[text]
        exact, before, behind = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint32), np.zeros(len(at), np.uint32)
        ok = (at - FLANK >= start) & (at + K + FLANK <= end)
        if ok.any():
            exact[ok] = mixed(runs(self.hash, K + 2 * FLANK))[at[ok] - FLANK]
        pair = mixed(runs(self.hash, 2))
        band = pair & np.uint64(BANDS - 1)
        every = np.zeros(len(pair) - SIDE + 2, np.uint32) if len(pair) >= SIDE else np.zeros(0, np.uint32)
        for b in range(BANDS if len(every) else 0):
            low = slide(np.where(band == np.uint64(b), pair >> np.uint64(8), _NONE), SIDE - 1, np.minimum)
            every |= (low & np.uint64(255)).astype(np.uint32) << np.uint32(8 * b)
        ok = at - SIDE >= start
        before[ok] = every[at[ok] - SIDE]
        ok = at + K + SIDE <= end
        behind[ok] = every[at[ok] + K]
        return exact, before, behind


def seeds(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the seeds of one text."""
    t = Texts([b" ".join(words)])
    hashes, _, at = t.seeds()
    return hashes.view(np.int64), at - t.first[0]


class Seen:
    """Keys that a task has met; forgets all at a bound, which costs a repeated row only."""

    def __init__(self):
        self.keys: set[int] = set()

    def new(self, key: int) -> bool:
        if key in self.keys:
            return False
        if len(self.keys) >= MOST_KEYS:
            self.keys.clear()
        self.keys.add(key)
        return True


def seed_counts(docs: DataFrame) -> DataFrame:
    """hash, n of the seeds that several texts hold; a text counts once in each task that meets it."""

    def run(batches):
        seen = Seen()
        for batch in batches:
            for b in slices_of(batch, 0):
                t = Texts([blanked(x.as_py()) for x in b.column(0)], LEAST)
                if len(t.rows):
                    hashes, text, _ = t.seeds()
                    new = np.array([seen.new(k) for k in t.keys])[text]
                    hashes, text = hashes[new], text[new]
                    if not len(hashes):
                        continue
                    order = np.lexsort((hashes, text))
                    hashes, text = hashes[order], text[order]
                    once = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])))
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[once].view(np.int64))], names=["hash"])

    every = small_batches(docs).select("text").mapInArrow(run, "hash long")
    return materialise(every.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-seeds")


def chain(matches: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Disjoint chains of matches (position here, position there), best first.

    A match leaves the tree once it lies too far behind, so the best one within the gap is taken.
    """
    matches = sorted(set(matches))
    there = sorted({b for _, b in matches})
    ranks, size = {b: i for i, b in enumerate(there)}, len(there)
    none = (float("-inf"), -1)
    tree = [none] * (2 * size)
    live: list[list[tuple[float, int]]] = [[] for _ in there]  # at each place there, best last
    score, back = [0.0] * len(matches), [-1] * len(matches)

    def put(r: int) -> None:
        tree[r + size] = live[r][-1] if live[r] else none
        r = (r + size) // 2
        while r:
            tree[r] = max(tree[2 * r], tree[2 * r + 1])
            r //= 2

    i = gone = 0
    while i < len(matches):
        while matches[gone][0] < matches[i][0] - GAP - K:
            r = ranks[matches[gone][1]]
            live[r].remove((score[gone] + COST * sum(matches[gone]), gone))
            put(r)
            gone += 1
        j = i
        while j < len(matches) and matches[j][0] == matches[i][0]:  # those at one place don't chain
            a, b = matches[j]
            best, lo, hi = none, bisect_left(there, b - GAP - K) + size, ranks[b] + size
            while lo < hi:
                if lo & 1:
                    best = max(best, tree[lo])
                    lo += 1
                if hi & 1:
                    hi -= 1
                    best = max(best, tree[hi])
                lo, hi = lo // 2, hi // 2
            score[j] = K
            if best[1] >= 0 and (gain := K + best[0] - COST * (a + b)) > K:
                score[j], back[j] = gain, best[1]
            j += 1
        for m in range(i, j):
            r = ranks[matches[m][1]]
            insort(live[r], (score[m] + COST * sum(matches[m]), m))
            put(r)
        i = j
    used, out = set(), []
    for m in sorted(range(len(matches)), key=lambda m: -score[m]):
        path = []
        while m >= 0 and m not in used:
            used.add(m)
            path.append(matches[m])
            m = back[m]
        if path:
            out.append(path[::-1])
    return out


def _between(a: list, b: list) -> list[tuple[int, int]]:
    """Equal words (i, j) of a longest common subsequence of two short stretches."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits, one set for each hash: built by the tasks, at most 2**bits / 64 rows here."""
    slot = F.shiftrightunsigned("hash", 6).bitwiseAND(F.lit((1 << (bits - 6)) - 1))
    words = hashes.select(slot.alias("slot"), F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("word")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("slot").to_numpy()] = words.column("word").to_numpy().view(np.uint64)
    return out


def in_bitmap(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For unsigned hashes, whether their bits are set."""
    return (known[(h >> np.uint64(6)) & np.uint64(len(known) - 1)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)


SPOT = "struct<seed:long,at:int,exact:long,before:int,behind:int>"


def places(docs: DataFrame, shared: DataFrame, bits: int = 26) -> DataFrame:
    """doc_id, key, n_words, spots (places of shared seeds; none for a copy met before) of texts of LEAST words or more.

    A bitmap of fixed size tells shared seeds; those it takes wrongly meet no other text.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(shared, bits))

    def run(batches):
        known, seen = sent.value, Seen()
        for batch in batches:
            for b in slices_of(batch, 1):
                t = Texts([blanked(x.as_py()) for x in b.column(1)], LEAST)
                new = np.array([seen.new(k) for k in t.keys], bool)
                names, kinds, cols = ["seed", "at", "exact", "before", "behind"], [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()], [np.empty(0, np.int64)] * 5
                ends = np.zeros(len(t.rows) + 1, np.int64)
                if len(t.rows):
                    hashes, text, at = t.places()
                    good = in_bitmap(known, hashes) & new[text]
                    hashes, text, at = hashes[good], text[good], at[good]
                    exact, before, behind = t.contexts(text, at)
                    cols = [hashes.view(np.int64), (at - t.first[text]).astype(np.int32), exact.view(np.int64), before.view(np.int32), behind.view(np.int32)]
                    ends[1:] = np.cumsum(np.bincount(text, minlength=len(t.rows)))
                spots = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
                spots = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spots)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(t.rows)), pa.array(t.keys, pa.int64()), pa.array(t.size, pa.int32()), spots], names=["doc_id", "key", "n_words", "spots"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, key long, n_words int, spots array<{SPOT}>")


ORDER = ("seed", "exact", "before", "behind", "key", "at")


def equal_bands(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bands in which signatures agree; none where one is missing."""
    d = x ^ y
    n = sum(((d >> np.uint32(8 * b)) & np.uint32(255) == 0).astype(np.int8) for b in range(BANDS))
    return np.where((x != 0) & (y != 0), n, 0)


def meet(spots: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Matches key > other, a, b, w among places in ORDER; w: equal bands, or EXACT."""
    x = spots
    again = (x["seed"][1:] == x["seed"][:-1]) & (x["key"][1:] == x["key"][:-1]) & (x["at"][1:] == x["at"][:-1])
    once = np.concatenate(([True], ~again))
    x = {c: v[once] for c, v in x.items()}
    seed, exact = x["seed"], x["exact"]
    new = np.concatenate(([True], seed[1:] != seed[:-1]))
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > CROWD
    ones, others = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def take(at, lag, ok):
        i = np.flatnonzero((group[at[:-lag]] == group[at[lag:]]) & ok[:-lag])
        ones.append(np.minimum(at[i], at[i + lag]))
        others.append(np.maximum(at[i], at[i + lag]))

    every = np.arange(len(seed))
    for lag in range(1, min(CROWD, len(seed))):
        take(every, lag, ~many)
    def star(at, *by):
        """Each place with the first among those that agree in ``by``, of places in such an order."""
        first = np.concatenate(([True], np.any([v[1:] != v[:-1] for v in by], axis=0)))
        centre = at[np.flatnonzero(first)[np.cumsum(first) - 1]]
        ones.append(np.minimum(at, centre)[~first])
        others.append(np.maximum(at, centre)[~first])
        return first

    if many.any():
        at = np.flatnonzero(many)
        at = at[np.lexsort((x["key"][at], exact[at], group[at]))]
        # places without an exact context are heads of their own
        same = np.where(exact[at] != 0, exact[at].view(np.int64), -1 - np.arange(len(at)))
        heads = at[star(at, group[at], same)]
        for side in (x["before"][heads], x["behind"][heads]):
            for turn in (0, 16):
                turned = (side << np.uint32(turn)) | (side >> np.uint32(32 - turn)) if turn else side
                order = np.lexsort((x["key"][heads], turned >> np.uint32(16), group[heads]))
                at, half = heads[order], turned[order] >> np.uint32(16)
                first = star(at, group[at], half)
                alone = heads[order][first & np.concatenate((first[1:], [True]))]
                order = np.lexsort((x["key"][heads], turned, group[heads]))
                take(heads[order], 1, np.isin(heads[order], alone))
    pairs = np.unique(np.concatenate(ones) * len(seed) + np.concatenate(others))
    i, j = pairs // max(1, len(seed)), pairs % max(1, len(seed))
    w = equal_bands(x["before"][i], x["before"][j]) + equal_bands(x["behind"][i], x["behind"][j])
    w = np.where((exact[i] == exact[j]) & (exact[i] != 0), EXACT, w)
    ok = (x["key"][i] != x["key"][j]) & (w > many[i])
    i, j, w = i[ok], j[ok], w[ok]
    swap = x["key"][i] < x["key"][j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    return {"key": x["key"][i], "other": x["key"][j], "a": x["at"][i], "b": x["at"][j], "w": w.astype(np.int32)}


MATCH = "key long, other long, a int, b int, w int"
_KINDS = {"seed": pa.int64(), "exact": pa.int64(), "before": pa.int32(), "behind": pa.int32(), "key": pa.int64(), "at": pa.int32()}


def meetings(batches, edges: bool):
    """meet() over sorted batches, a seed at a time, or a block of a seed with more places.

    ``edges``: also the first and the last place of the partition, with no other.
    """
    kind = {"key": pa.int64(), "other": pa.int64(), "a": pa.int32(), "b": pa.int32(), "w": pa.int32()} | ({c: _KINDS[c] for c in ("seed", "exact", "before", "behind")} if edges else {})

    def out(cols, n):
        return pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols else pa.nulls(n, t) for c, t in kind.items()], names=list(kind))

    def edge(x, i):
        return out({"key": x["key"][i : i + 1], "a": x["at"][i : i + 1]} | {c: x[c][i : i + 1].view(_KINDS[c].to_pandas_dtype()) for c in ("seed", "exact", "before", "behind")}, 1)

    joined = lambda parts: {c: np.concatenate([x[c] for x in parts]) for c in ORDER}
    waiting, size, begun = [], 0, False
    for b in batches:
        if not b.num_rows:
            continue
        waiting.append({c: b.column(c).to_numpy() for c in ORDER} | {c: b.column(c).to_numpy().view(np.uint32) for c in ("before", "behind")})
        if edges and not begun:
            yield edge(waiting[0], 0)
        begun, size = True, size + b.num_rows
        if size < BLOCK:
            continue
        held = joined(waiting)
        cut = int(np.searchsorted(held["seed"], held["seed"][-1]))
        # of a seed that goes on beyond a block, the last place stays to meet the next ones
        done, rest = (cut, cut) if cut else (len(held["seed"]), len(held["seed"]) - 1)
        m = meet({c: v[:done] for c, v in held.items()})
        yield out(m, len(m["key"]))
        waiting = [{c: v[rest:] for c, v in held.items()}]
        size = len(waiting[0]["seed"])
    if begun:
        held = joined(waiting)
        m = meet(held)
        yield out(m, len(m["key"]))
        if edges:
            yield edge(held, len(held["seed"]) - 1)


def matches(held: DataFrame, shared: DataFrame, parts: int = 8) -> DataFrame:
    """key > other, a, b, w of places of a seed that met.

    Seeds with over 1 / ``parts`` of an even share of all places a task are hot; there are
    at most ``parts`` times as many of them as tasks.
    """
    spark = held.sparkSession
    tasks = parts * int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = shared.agg(F.sum("n")).first()[0] or 0
    hot = [r.hash for r in shared.where(F.col("n") * tasks > total).where(F.col("n") > CROWD).select("hash").collect()]
    rows = held.select("key", F.explode("spots").alias("s")).select("key", "s.*").select(*ORDER)
    hot = F.broadcast(spark.createDataFrame([(h,) for h in hot], "seed long"))
    found = rows.join(hot, "seed", "left_anti").select(*ORDER).repartition("seed").sortWithinPartitions(*ORDER).mapInArrow(lambda b: meetings(b, False), MATCH)
    dealt = rows.join(hot, "seed", "left_semi").select(*ORDER).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    dealt = materialise(dealt.mapInArrow(lambda b: meetings(b, True), f"{MATCH}, seed long, exact long, before int, behind int"), "hot-matches")
    # where two tasks meet: their edges are two rows a task at most
    edges = dealt.where("other is null").select("seed", "exact", "before", "behind", "key", F.col("a").alias("at")).repartition(1)
    here = F.struct("seed", "exact", "key", "at")
    edges = edges.withColumn("p", F.lag(here).over(Window.orderBy(*ORDER))).where("p.seed = seed and p.exact = exact and exact <> 0 and p.key <> key")
    swap = F.col("p.key") > F.col("key")
    pick = lambda x, y: F.when(swap, F.col(x)).otherwise(F.col(y))
    edges = edges.select(pick("p.key", "key").alias("key"), pick("key", "p.key").alias("other"), pick("p.at", "at").alias("a"), pick("at", "p.at").alias("b"), F.lit(EXACT).alias("w"))
    names = ["key", "other", "a", "b", "w"]
    return found.unionByName(dealt.where("other is not null").select(*names)).unionByName(edges.select(*names))


#: Words on each side of a place that decide whether two places of a crowded seed can lie in a passage:
#: a stretch that isn't one by itself, and the margin or the gap beyond it.
REACH = 88
#: Words of a stretch that may be a passage by themselves.
ENOUGH = int(LEAST * SHARE)
#: Lengths of an equal stretch on one side that are told apart.
REST = REACH - 4
#: Places of a crowded seed that one task compares with as many others, and pairs that are tested at once.
CELL, AT_ONCE = 8192, 1 << 12
#: How far a passage of fewer than 2 * LEAST words shifts its equal words at most.
SHIFT = 20
#: An alignment that is SHARE equal has no score below 0 if an equal word scores 1 and a skipped one, in either text, SKIP.
SKIP = round(SHARE / 2 / (1 - SHARE))
_NEAR = np.dtype([("e", "i1"), ("code", "<u4")])  # a shared seed: words from a place to it, bytes of its words


def crowded_places(docs: DataFrame, shared: DataFrame, crowd: DataFrame, bits: int = 26) -> DataFrame:
    """seed, key, at, prev, step, words, near of the places of crowded seeds.

    prev, step: hash of and distance to the crowded seed that touches or overlaps it from before (else 0);
    words: a byte of hash (1 to 254) for each of REACH words outwards to the left and to the right, 0 beyond the text,
    and of the seed's own; near: a bit for each word within REACH at which another shared seed begins.
    """
    sc = docs.sparkSession.sparkContext
    sent, full = sc.broadcast(bitmap(shared, bits)), sc.broadcast(bitmap(crowd.select(F.col("seed").alias("hash")), bits))
    kinds = {"seed": pa.int64(), "key": pa.int64(), "at": pa.int32(), "prev": pa.int64(), "step": pa.int32(), "words": pa.binary(), "near": pa.binary()}

    def run(batches):
        known, many, seen = sent.value, full.value, Seen()
        for batch in batches:
            for b in slices_of(batch, 0, 250_000):
                t = Texts([blanked(x.as_py()) for x in b.column(0)], LEAST)
                if not len(t.rows):
                    continue
                new = np.array([seen.new(k) for k in t.keys], bool)
                h, text, at = t.places()
                good = in_bitmap(known, h) & new[text]
                h, text, at = h[good], text[good], at[good]
                mine = np.flatnonzero(in_bitmap(many, h))
                if not len(mine):
                    continue
                prev, step = np.zeros(len(mine), np.uint64), np.zeros(len(mine), np.int32)
                gap = np.diff(at[mine])
                joined = np.flatnonzero((gap <= K) & (text[mine][1:] == text[mine][:-1]))
                prev[joined + 1], step[joined + 1] = mixed(h[mine][joined] + gap[joined].astype(np.uint64)), gap[joined]
                code = np.concatenate((np.zeros(REACH, np.uint8), ((t.hash >> np.uint64(20)) % np.uint64(254) + np.uint64(1)).astype(np.uint8), np.zeros(REACH + K, np.uint8)))
                place, start = at[mine], t.first[text[mine]]
                end, out = start + t.size[text[mine]], np.arange(REACH)
                left, right = place[:, None] - 1 - out, place[:, None] + K + out
                words = np.concatenate((np.where(left >= start[:, None], code[left + REACH], 0), np.where(right < end[:, None], code[right + REACH], 0), code[place[:, None] + np.arange(K) + REACH]), axis=1).astype(np.uint8)
                lo, hi = np.searchsorted(at, place - REACH), np.searchsorted(at, place + REACH, "right")
                row = np.repeat(np.arange(len(mine)), hi - lo)
                other = np.arange(len(row)) - np.repeat(np.cumsum(hi - lo) - hi, hi - lo)
                keep = (text[other] == text[mine][row]) & (other != mine[row])
                row, other = row[keep], other[keep]
                near = np.zeros((len(mine), 2 * REACH + 1), bool)
                near[row, at[other] - place[row] + REACH] = True
                binary = lambda x: pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]).tobytes()), pa.py_buffer(x.tobytes())])
                cols = [h[mine].view(np.int64), np.array(t.keys, np.int64)[text[mine]], (place - start).astype(np.int32), prev.view(np.int64), step]
                cols = [pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=False)]
                cols += [binary(words), binary(np.packbits(near, axis=1))]
                yield pa.RecordBatch.from_arrays(cols, names=list(kinds))

    return small_batches(docs).select("text").mapInArrow(run, "seed long, key long, at int, prev long, step int, words binary, near binary")


class Places:
    """Places of crowded seeds with what decides whether two of them can lie in a passage."""

    LOW, HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)
    ONES, TOPS = np.uint64(0x0001000100010001), np.uint64(0x8000800080008000)

    def __init__(self, words: np.ndarray, row: np.ndarray, near: np.ndarray, cell: np.ndarray | None = None):
        """words: (places, 2 * REACH) bytes; row: of each of ``near``; cell: of each place, of which only pairs within one are asked for."""
        n = len(words)
        side = words.reshape(n, 2, REACH)
        # what lies beyond a text is another value on each side of a comparison
        both = [words, np.where(words == 0, 255, words).astype(np.uint8)]
        self.words = [np.ascontiguousarray(x).view(np.uint64) for x in both]
        self.first = [np.ascontiguousarray(x.reshape(n, 2, REACH)[:, :, :16]).view(np.uint64).reshape(n, 4) for x in both]
        # half a byte of each word
        half = words % 14 + 1
        self.halves = [np.ascontiguousarray(x[:, ::2] | (x[:, 1::2] << 4)).view(np.uint64) for x in (np.where(words == 0, no, half).astype(np.uint8) for no in (0, 15))]
        pair = side[:, :, :-1].astype(np.uint64) | (side[:, :, 1:].astype(np.uint64) << np.uint64(8))
        ok = (side[:, :, :-1] != 0) & (side[:, :, 1:] != 0)
        # pairs of words from each place on, four at once
        self.follow = [sum(np.where(ok, pair, np.uint64(no))[:, :, k : k + REST] << np.uint64(16 * k) for k in range(4)).ravel() for no in (0, 1)]
        # a seed that no other place of the cell has nearby says nothing
        code = near["code"].astype(np.int64) | ((np.zeros(n, np.int64) if cell is None else cell)[row] << 32)
        if len(code):
            order = np.argsort(code, kind="stable")
            new = np.concatenate(([True], code[order][1:] != code[order][:-1]))
            group = np.cumsum(new) - 1
            held = np.empty(len(code), bool)
            held[order] = (np.maximum.reduceat(row[order], np.flatnonzero(new)) != np.minimum.reduceat(row[order], np.flatnonzero(new)))[group]
            row, near = row[held], near[held]
        # of each place and side by distance, to be gone through, and by code, to be looked up
        line = 2 * row.astype(np.int64) + (near["e"] > 0)
        order = np.lexsort((np.abs(near["e"].astype(np.int16)), line))
        self.spot = (near["code"].astype(np.int64) << 8 | (near["e"].astype(np.int64) + 128))[order]
        self.far = line[order] << 8 | np.abs(near["e"].astype(np.int64))[order]
        self.held = np.sort(line[order] << 40 | self.spot)
        # two bitmaps of 64 bits of the shared seeds beyond each number of words
        self.near = np.zeros((2, n, 2, REST), np.uint64)
        far = np.minimum(np.abs(near["e"].astype(np.int64)) - 1, REST - 1)
        for maps, bit in zip(self.near, (near["code"] & 63, (near["code"] >> 6) & 63), strict=True):
            np.bitwise_or.at(maps, (row, (near["e"] > 0).astype(np.int64), far), np.uint64(1) << bit.astype(np.uint64))
        for x in range(REST - 2, -1, -1):
            self.near[..., x] |= self.near[..., x + 1]
        self.near = self.near.reshape(2, -1)

    def further(self, i: np.ndarray, j: np.ndarray, side: int, run: np.ndarray, sure: bool = False) -> np.ndarray:
        """Whether two equal words follow within the skips beyond ``run`` equal ones, or a shared seed may (``sure``: does)."""
        x, y = (2 * i + side) * REST + run, (2 * j + side) * REST + run
        more = ((self.near[0].take(x) & self.near[0].take(y)) != 0) & ((self.near[1].take(x) & self.near[1].take(y)) != 0)
        if sure and (hit := np.flatnonzero(more)).size:
            more[hit] = self.shared(i[hit], j[hit], side, run[hit])
        a, b = self.follow[0].take(x), self.follow[1].take(y)
        for turn in (0, 16, 32, 48):
            t = a ^ ((b << np.uint64(turn)) | (b >> np.uint64(64 - turn)) if turn else b)
            more |= ((t - self.ONES) & ~t & self.TOPS) != 0
        return more

    def shared(self, i: np.ndarray, j: np.ndarray, side: int, run: np.ndarray) -> np.ndarray:
        """Whether a seed of i beyond ``run`` equal words is one of j as well, at most SHIFT words off."""
        out = np.zeros(len(i), bool)
        for s in range(0, len(i), AT_ONCE):
            x, y, r = (v[s : s + AT_ONCE] for v in (2 * i + side, 2 * j + side, run))
            lo, hi = np.searchsorted(self.far, x << 8 | (r + 1)), np.searchsorted(self.far, (x + 1) << 8)
            pair = np.repeat(np.arange(len(x)), hi - lo)
            spot = self.spot[np.arange(len(pair)) + np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo)]
            first = (y[pair] << 40 | spot) - SHIFT
            at = np.searchsorted(self.held, first)
            ok = at < len(self.held)
            ok[ok] = self.held[at[ok]] - first[ok] <= 2 * SHIFT
            out[s + pair[ok]] = True
        return out

    def straight(self, unequal: np.ndarray) -> np.ndarray:
        """Whether words equal at equal distances make up a passage around the place, or may in a longer one than is in reach."""
        equal = ((unequal.view(np.uint8) == 0).reshape(len(unequal), 2, REACH)).astype(np.int32)
        count = np.cumsum(equal, axis=2)
        # by words on a side (0 on): equal ones less SHARE of all, times 100
        less = np.zeros((len(unequal), 2, REACH + 1), np.int32)
        less[:, :, 1:] = 100 * count - int(100 * SHARE) * np.arange(1, REACH + 1)
        best = np.maximum.accumulate(less[:, 1, ::-1], axis=1)[:, ::-1]  # with so many words at least
        need = np.maximum(LEAST - K - np.arange(REACH + 1), 0)
        return (less[:, 0] + best[:, need] + (100 - int(100 * SHARE)) * K >= 0).any(axis=1) | (2 * count[:, :, -1] >= REACH).any(axis=1)

    def unequal(self, d: np.ndarray) -> np.ndarray:
        """The highest bit of each byte that isn't zero."""
        return (((d & self.LOW) + self.LOW) | d) & self.HIGH

    @staticmethod
    def bytes_before(u: np.ndarray) -> np.ndarray:
        """The number of zero bytes before the first other one."""
        return (np.bitwise_count((u & (~u + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64)

    def maybe(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """True wherever may() is, from less of the words."""
        t = self.halves[0].take(i, axis=0)
        t ^= self.halves[1].take(j, axis=0)
        t |= t >> np.uint64(1)
        t |= t >> np.uint64(2)
        t &= np.uint64(0x1111111111111111)
        out = 2 * REACH - np.bitwise_count(t).sum(axis=1, dtype=np.uint8) + K >= ENOUGH
        unequal = self.unequal(self.first[0].take(i, axis=0) ^ self.first[1].take(j, axis=0))
        for side in (0, 1):
            u, v = unequal[:, 2 * side], unequal[:, 2 * side + 1]
            late = u == 0
            u = np.where(late, v, u)
            out |= u == 0
            out |= self.further(i, j, side, self.bytes_before(u) + 8 * late)
        return out

    def may(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether places i and j of one seed can lie in a passage of their texts that chains and alignment find.

        They can't if the words equal at equal distances make up no passage, no two equal words follow
        within the skips beyond the equal stretch, and no other shared seed of both is in reach beyond it;
        nor if no alignment outwards from both scores enough. A longer passage has a part of
        LEAST to 2 * LEAST words that is one too.
        """
        unequal = self.unequal(self.words[0][i] ^ self.words[1][j])
        may = 2 * REACH - np.bitwise_count(unequal).sum(axis=1, dtype=np.int64) + K >= ENOUGH
        may[may] = self.straight(unequal[may])
        i, j, rest = i[~may], j[~may], np.flatnonzero(~may)
        unequal = unequal[~may].reshape(len(i), 2, REACH // 8)
        more = np.zeros(len(i), bool)
        for side in (0, 1):
            first = (unequal[:, side] != 0).argmax(axis=1)
            run = np.where(unequal.any(axis=2)[:, side], first * 8 + self.bytes_before(unequal[np.arange(len(i)), side, first]), REACH)
            more |= self.further(i, j, side, np.minimum(run, REST - 1), True)
        hit = np.flatnonzero(more)
        more[hit] = self.alike(i[hit], j[hit])
        may[rest] = more
        return may


    def scores(self, i: np.ndarray, j: np.ndarray, side: int) -> np.ndarray:
        """The best score of an alignment outwards over each number of words (0 on) of the text with more, on one side."""
        x, y = (np.zeros((REACH + 1, len(i)), np.uint8), np.full((REACH + 1, len(i)), 255, np.uint8))
        x[1:], y[1:] = (w.view(np.uint8).reshape(-1, 2, REACH)[k, side].T for w, k in zip(self.words, (i, j), strict=True))
        low = np.int8(-100)  # no other side makes up for that
        best, at = np.full((REACH + 1, len(i)), low), np.full((2 * SHIFT + 3, len(i)), low)
        mid = SHIFT + 1  # by the shift of y to x; those of other parity are of one word less in all
        best[0] = at[mid] = 0
        for n in range(1, 2 * REACH + 1):
            odd, far = n % 2, min(SHIFT, n, 2 * REACH - n)
            far -= (far - n) % 2
            lo, hi = (n - far) // 2, (n + far) // 2
            now = (x[lo : hi + 1][::-1] == y[lo : hi + 1]).view(np.int8)
            now *= np.int8(1 + 2 * SKIP)
            now -= np.int8(2 * SKIP)
            now += at[mid - far : mid + far + 1 : 2]
            skip = np.maximum(at[mid - far - 1 : mid + far : 2], at[mid - far + 1 : mid + far + 2 : 2])
            skip -= np.int8(SKIP)
            np.maximum(now, skip, out=now)
            np.maximum(now, low, out=now)
            at[mid - far : mid + far + 1 : 2] = now
            part = best[(n + odd) // 2 : hi + 1]
            np.maximum(part, now[(far + odd) // 2 :], out=part)
            np.maximum(part, now[: (far - odd) // 2 + 1][::-1], out=part)
        best[REACH] += np.int8(max(2 * LEAST - K - REACH, 0))  # what may follow out of reach
        return best

    def alike(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether an alignment through both places scores as a passage of up to 2 * LEAST words has to."""
        out = np.zeros(len(i), bool)
        need = np.maximum(LEAST - K - np.arange(REACH + 1), 0)
        for s in range(0, len(i), 1 << 10):
            left, right = (self.scores(i[s : s + 1024], j[s : s + 1024], side).astype(np.int16) for side in (0, 1))
            right = np.maximum.accumulate(right[::-1], axis=0)[::-1]  # over so many words at least
            out[s : s + 1024] = (left + right[need] + K >= 0).any(axis=0)
        return out


def all_meetings(batches):
    """Matches of all pairs of places in each cell that can lie in a passage, one for each equal stretch of two texts."""
    names = ["seed", "lo", "hi", "side", "key", "at", "prev", "inside", "before"]

    def cells(x, words, near):
        same = np.all([x[c][1:] == x[c][:-1] for c in ("seed", "lo", "hi", "side", "key", "at")], axis=0)
        once = np.flatnonzero(np.concatenate(([True], ~same)))  # a text is met again in each task
        x, words = {c: v[once] for c, v in x.items()}, words[once]
        row, near = seeds_near(words, near[once])
        new = np.concatenate(([True], np.any([x[c][1:] != x[c][:-1] for c in ("seed", "lo", "hi")], axis=0), [True]))
        places, cut = Places(words[:, : 2 * REACH], row, near, np.cumsum(new[:-1])), np.flatnonzero(new)
        waiting, size = [], 0

        def test():
            i, j = (np.concatenate(v) for v in zip(*waiting, strict=True))
            ok = np.concatenate([places.maybe(i[s : s + AT_ONCE], j[s : s + AT_ONCE]) for s in range(0, len(i), AT_ONCE)])
            i, j = i[ok], j[ok]
            for s in range(0, len(i), 4 * AT_ONCE):
                a, b = i[s : s + 4 * AT_ONCE], j[s : s + 4 * AT_ONCE]
                ok = places.may(a, b)
                a, b = a[ok], b[ok]
                swap = x["key"][a] < x["key"][b]
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                cols = [x["key"][a], x["key"][b], x["at"][a], x["at"][b], np.full(len(a), LIKE, np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 2 + [pa.int32()] * 3, strict=True)], names=["key", "other", "a", "b", "w"])

        for s, e in itertools.pairwise(cut.tolist()):
            turn = s + int(np.searchsorted(x["side"][s:e], 1))
            rows, cols = (s, turn), ((turn, e) if turn < e else (s, e))
            if x["lo"][s] != x["hi"][s] and turn in (s, e):
                continue
            for r, c in itertools.product(range(*rows, 256), range(*cols, 1024)):
                if cols[0] == s and c + 1024 <= r:
                    continue
                a, b = np.arange(r, min(r + 256, rows[1])), np.arange(c, min(c + 1024, cols[1]))
                eq = lambda c: x[c][a][:, None] == x[c][b]  # noqa: B023, E731
                known = lambda c: eq(c) & (x[c][a] != 0)[:, None]  # noqa: B023, E731
                # left out: places in passages of one class, and what the seed before stands for
                ok = ~eq("key") & ~known("inside") & ~(known("prev") & ~known("before"))
                if cols[0] == s:
                    ok &= a[:, None] < b
                i, j = np.nonzero(ok)
                if len(i):
                    waiting.append((a[i], b[j]))
                    size += len(i)
                if size >= 64 * AT_ONCE:
                    yield from test()
                    waiting, size = [], 0
        if waiting:
            yield from test()

    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size < CELL // 2:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        x = {c: t.column(c).to_numpy() for c in names}
        last = np.any([x[c] != x[c][-1] for c in ("seed", "lo", "hi")], axis=0)
        cut = int(last.sum())  # the last cell may go on
        if cut:
            yield from cells({c: v[:cut] for c, v in x.items()}, bytes_of(t.column("words").slice(0, cut)), bytes_of(t.column("near").slice(0, cut)))
            held = t.slice(cut).to_batches()
            size = t.num_rows - cut
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield from cells({c: t.column(c).to_numpy() for c in names}, bytes_of(t.column("words")), bytes_of(t.column("near")))


def bytes_of(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def seeds_near(words: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and _NEAR of each shared seed near a place, from bytes of words and bits of positions."""
    row, e = np.nonzero(np.unpackbits(near, axis=1, count=2 * REACH + 1))
    line = np.concatenate((words[:, REACH - 1 :: -1], words[:, 2 * REACH :], words[:, REACH : 2 * REACH]), axis=1).astype(np.uint32)
    found = np.empty(len(row), _NEAR)
    found["e"], found["code"] = e - REACH, sum(line[row, e + k] << np.uint32(8 * k) for k in range(K))
    return row, found


def crowded_matches(docs: DataFrame, shared: DataFrame, crowd: DataFrame, found: DataFrame) -> DataFrame:
    """Matches of all places of crowded seeds that can lie in a passage beyond those found.

    Places of a seed are dealt into blocks of about CELL; each two blocks meet in a task.
    """
    classes = components(found.select(F.col("key").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "key")
    ranges = both_ways(found).groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    known = materialise(ranges.join(classes, "key"), "known-passages")
    inside = lambda at: F.when(F.exists("ranges", lambda r: (r["start"] <= at) & (at + K <= r["end"])), F.col("component")).otherwise(F.lit(0))
    rows = crowded_places(docs, shared, crowd).join(crowd, "seed", "left").join(known, "key", "left")
    rows = rows.withColumn("inside", inside(F.col("at"))).withColumn("before", inside(F.col("at") - F.col("step")))
    # a seed that the bitmap takes wrongly is tested too, as it may be the one before another
    blocks = F.coalesce(F.ceil(F.col("n") / CELL), F.lit(1)).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key", "at"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cell = ["seed", "lo", "hi"]
    rows = rows.select("seed", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), (F.col("block") > F.col("with")).cast("int").alias("side"), "key", "at", "prev", "inside", "before", "words", "near")
    return rows.repartition(*cell).sortWithinPartitions(*cell, "side", "key", "at").mapInArrow(all_meetings, MATCH)


#: Words skipped in either text, nearest first, to where two equal words follow beyond an edit.
SKIPS = sorted(((i, j) for i in range(4) for j in range(4) if i or j), key=lambda s: (max(s), -min(s), s))


def grown(a: dict, b: dict, x: int, y: int, step: int) -> list[tuple[int, int]]:
    """Positions of equal words beyond (x, y) in one direction, over edits of a few words."""
    out: list[tuple[int, int]] = []
    x, y = x + step, y + step
    while x in a and y in b:
        if a[x] != b[y]:
            for i, j in SKIPS:
                u, v = x + step * i, y + step * j
                if u in a and a[u] == b.get(v) and u + step in a and a[u + step] == b.get(v + step):
                    break
            else:
                break
            x, y = u, v
        out.append((x, y))
        x, y = x + step, y + step
    return out


def beyond(pairs: list[tuple[int, int]], x: int, y: int) -> list[tuple[int, int]]:
    """The longest part of what has grown beyond (x, y) with SHARE of its words equal."""
    for n in range(len(pairs), 0, -1):
        if n >= SHARE * max(abs(pairs[n - 1][0] - x), abs(pairs[n - 1][1] - y)):
            return pairs[:n]
    return []


def align(a: dict, b: dict, path: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Positions of equal words along a chain and beyond its ends; a, b: words by position."""
    pairs: list[tuple[int, int]] = []
    x, y = path[0]
    for s, t in path:
        if pairs:
            x, y = pairs[-1][0] + 1, pairs[-1][1] + 1
        if s > x and t > y:
            while x < s and y < t and a[x] == b[y]:
                pairs.append((x, y))
                x, y = x + 1, y + 1
            pairs += [(x + i, y + j) for i, j in _between([a[i] for i in range(x, s)], [b[j] for j in range(y, t)])]
        skip = max(x - s, y - t, 0) if pairs else 0
        pairs += [(s + i, t + i) for i in range(min(skip, K), K)]
    return grown(a, b, *pairs[0], -1)[::-1] + pairs + grown(a, b, *pairs[-1], 1)


def pieces(stretches) -> list[tuple[int, int, int]]:
    """Disjoint pieces (start, other start, length) of equal stretches that come along a chain."""
    out: list[tuple[int, int, int]] = []
    for x, y, n in stretches:
        while out and out[-1][1] - out[-1][0] == y - x and out[-1][0] >= x:
            u, _, m = out.pop()
            n = max(n, u + m - x)
        if out:
            u, v, m = out[-1]
            if v - u == y - x and u + m >= x:
                out[-1] = (u, v, max(m, x + n - u))
                continue
            cut = max(u + m - x, v + m - y, 0)
            x, y, n = x + cut, y + cut, n - cut
        if n > 0:
            out.append((x, y, n))
    return out


def passages(part: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Stretches (start, end, other start, other end) of LEAST words with SHARE of them equal."""
    out, lo = [], 0
    hole = lambda p, q: max(q[0] - p[0], q[1] - p[1]) - p[2]
    for i in range(1, len(part) + 1):
        if i < len(part) and hole(part[i - 1], part[i]) < GAP // 2:
            continue
        a, b, lo = lo, i, i
        equal = sum(p[2] for p in part[a:b])
        while equal >= LEAST * SHARE:
            (x, y, _), (u, v, n) = part[a], part[b - 1]
            size = max(u + n - x, v + n - y)
            if equal >= SHARE * size:
                if size >= LEAST:
                    out.append((x, u + n, y, v + n))
                break
            # drop the end with the wider hole for its words
            if hole(part[a], part[a + 1]) * part[b - 1][2] >= hole(part[b - 2], part[b - 1]) * part[a][2]:
                equal -= part[a][2]
                a += 1
            else:
                equal -= part[b - 1][2]
                b -= 1
    return out


def numbered(side: tuple[int, np.ndarray]) -> dict[int, int]:
    """Words by position, of a stretch that starts at a position."""
    return dict(enumerate(side[1].tolist(), side[0]))


def straight_passages(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray], path: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Passages over all of a chain without words left out or put in, from word by word equality; else none."""
    shift = path[0][1] - path[0][0]
    if path[-1][1] - path[-1][0] != shift:
        return []
    lo, hi = max(a[0], b[0] - shift), min(a[0] + len(a[1]), b[0] + len(b[1]) - shift)
    if hi <= lo:
        return []
    equal = a[1][lo - a[0] : hi - a[0]] == b[1][lo + shift - b[0] : hi + shift - b[0]]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], equal, [False])).astype(np.int8))) + lo
    found = passages([(x, x + shift, y - x) for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
    return found if any(s <= path[0][0] and path[-1][0] + K <= e for s, e, _, _ in found) else []


def settle(found: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int, int]], list[list[tuple[int, int]]]]:
    """Passages that the matches (a, b, w) of two texts prove, and chains that are to be aligned."""
    if len(found) == 1:  # no context is as long as a passage
        return [], [[found[0][:2]]] if found[0][2] >= LIKE else []
    weight: dict[tuple[int, int], int] = {}
    for a, b, w in found:
        weight[a, b] = max(w, weight.get((a, b), 0))
    line = sorted(weight)
    straight = all(q[0] - p[0] == q[1] - p[1] and 2 * COST * (q[0] - p[0]) <= K for p, q in itertools.pairwise(line))
    proved, todo = [], []
    for path in [line] if straight else chain(line):
        if sum(weight[m] for m in path) < LIKE:
            continue
        reach = K * len(path) + 2 * FLANK * sum(weight[m] == EXACT for m in path)
        sure = passages(pieces((a - FLANK, b - FLANK, K + 2 * FLANK) if weight[a, b] == EXACT else (a, b, K) for a, b in path)) if reach >= LEAST * SHARE else []
        proved += sure
        if not sure:
            todo.append(path)
            continue
        for inside, part in itertools.groupby(path, lambda m: any(s <= m[0] and m[0] + K <= e for s, e, _, _ in sure)):
            part = list(part)
            if not inside and part[-1][0] + K - part[0][0] >= LEAST // 2:
                todo.append(part)
    return proved, todo


PASSAGE, PATH = "struct<start:int,end:int,other_start:int,other_end:int>", "array<struct<a:int,b:int>>"


def chains(met: DataFrame) -> DataFrame:
    """key, other, proved (passages), todo (paths to align) of pairs of texts whose places met."""
    grouped = met.groupBy("key", "other").agg(F.collect_list(F.struct("a", "b", "w")).alias("m"))
    span = pa.list_(pa.struct([(c, pa.int32()) for c in ("start", "end", "other_start", "other_end")]))
    paths = pa.list_(pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))

    def run(batches):
        for b in batches:
            keys, others, proved, todo = [], [], [], []
            flat, ends = b.column(2).flatten(), b.column(2).offsets.to_pylist()
            base = ends[0]
            cols = [flat.field(c).to_pylist() for c in ("a", "b", "w")]
            for key, other, s, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), ends, ends[1:], strict=False):
                sure, open_ = settle(list(zip(*(c[s - base : e - base] for c in cols), strict=True)))
                if sure or open_:
                    keys.append(key)
                    others.append(other)
                    proved.append([dict(zip(("start", "end", "other_start", "other_end"), p, strict=True)) for p in sure])
                    todo.append([[{"a": x, "b": y} for x, y in path] for path in open_])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(others, pa.int64()), pa.array(proved, span), pa.array(todo, paths)], names=["key", "other", "proved", "todo"])

    return grouped.mapInArrow(run, f"key long, other long, proved array<{PASSAGE}>, todo array<{PATH}>")


def ends_of(found: DataFrame) -> DataFrame:
    """key, other, path, step: the outermost ends of the passages that touch in a text, to be looked at once."""
    # a centre of many stars has as many partners, but no more spans than its own length allows
    rows = both_ways(found).groupBy("key", "start", "end").agg(F.min(F.struct("other", "other_start", "other_end")).alias("o")).select("key", "start", "end", "o.*")
    by = Window.partitionBy("key").orderBy("start", "end", "other", "other_start")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(by))
    far = rows.groupBy("key", "island").agg(F.min(F.struct("start", "other", "other_start")).alias("l"), F.max(F.struct("end", "other", "other_end")).alias("r"))
    one = lambda e, a, b, step: F.struct(F.col(f"{e}.other").alias("other"), F.array(F.struct(F.col(f"{e}.{a}").alias("a"), F.col(f"{e}.{b}").alias("b"))).alias("path"), F.lit(step).alias("step"))
    return far.select("key", F.explode(F.array(one("l", "start", "other_start", -1), one("r", "end", "other_end", 1))).alias("e")).select("key", "e.*")


def both_ways(found: DataFrame) -> DataFrame:
    """Passages as each of the two texts sees them."""
    turned = found.select(F.col("other").alias("key"), F.col("other_start").alias("start"), F.col("other_end").alias("end"), F.col("key").alias("other"), F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    return found.select(*turned.columns).unionByName(turned)


def tiles(docs: DataFrame, wanted: DataFrame, bits: int = 24) -> DataFrame:
    """key, tile, words (32 bits of hash each) of the wanted (key, tile)s.

    A bitmap of fixed size keeps most other texts out of the shuffle; the join decides.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.col("key").alias("hash")), bits))

    def run(batches):
        known, seen = sent.value, Seen()
        for b in batches:
            rows = ([], [], [])
            for part in slices_of(b, 0):
                t = Texts([blanked(x.as_py()) for x in part.column(0)], LEAST)
                asked = in_bitmap(known, np.array(t.keys, np.int64).view(np.uint64))
                for i in np.flatnonzero(asked).tolist():
                    if seen.new(t.keys[i]):
                        h = (t.words(i) >> np.uint64(32)).astype("<u4")
                        for x in range(0, len(h), TILE):
                            rows[0].append(t.keys[i])
                            rows[1].append(x // TILE)
                            rows[2].append(h[x : x + TILE].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.binary())], names=["key", "tile", "words"])

    every = small_batches(docs).select("text").mapInArrow(run, "key long, tile int, words binary")
    return every.join(wanted, ["key", "tile"], "left_semi").groupBy("key", "tile").agg(F.first("words").alias("words"))


def aligned(docs: DataFrame, todo: DataFrame) -> DataFrame:
    """key, start, end, other, other_start, other_end of the passages on the paths.

    step 0: a chain; -1, 1: an end of a passage, which gives what goes on beyond it.
    """
    todo = todo.withColumn("id", F.xxhash64("key", "other", F.col("path").cast("string"), "step"))
    first = lambda side: F.get("path", F.lit(0))[side]
    last = lambda side: F.element_at("path", -1)[side]
    low = lambda side: F.when(F.col("step") <= 0, F.greatest(first(side) - MARGIN, F.lit(0))).otherwise(first(side))
    high = lambda side: F.when(F.col("step") == 0, last(side) + K + MARGIN).when(F.col("step") > 0, last(side) + MARGIN).otherwise(F.greatest(last(side) - 1, F.lit(0)))
    need = lambda key, side, n: todo.select("id", F.lit(n).alias("side"), F.col(key).alias("key"), F.explode(F.sequence(F.floor(low(side) / TILE).cast("int"), F.floor(high(side) / TILE).cast("int"))).alias("tile"))
    needs = need("key", "a", 0).unionByName(need("other", "b", 1))
    wanted = materialise(needs.select("key", "tile").distinct(), "wanted-tiles")
    have = materialise(tiles(docs, wanted), "tiles")
    got = needs.join(have, ["key", "tile"]).groupBy("id").agg(F.collect_list(F.struct("side", "tile", "words")).alias("tiles"))
    rows = todo.join(got, "id").select("key", "other", "path", "step", "tiles")

    def run(batches):
        for b in batches:
            out = []
            keys, others, steps = (b.column(i).to_pylist() for i in (0, 1, 3))
            paths, tiles_ = b.column(2), b.column(4)
            at, held = paths.flatten(), tiles_.flatten()
            at = list(zip(at.field("a").to_pylist(), at.field("b").to_pylist(), strict=True))
            held = list(zip(held.field("side").to_pylist(), held.field("tile").to_pylist(), held.field("words").to_pylist(), strict=True))
            cuts = [(x.offsets.to_numpy() - x.offsets[0].as_py()).tolist() for x in (paths, tiles_)]
            for k, (key, other, step) in enumerate(zip(keys, others, steps, strict=True)):
                path, parts = (x[c[k] : c[k + 1]] for x, c in zip((at, held), cuts, strict=True))
                parts.sort()
                sides = []
                for side in (0, 1):
                    mine = [p for p in parts if p[0] == side]
                    sides.append((mine[0][1] * TILE if mine else 0, np.frombuffer(b"".join(p[2] for p in mine), "<u4")))
                if not step:
                    found = straight_passages(*sides, path) or passages(pieces((x, y, 1) for x, y in align(*map(numbered, sides), path)))
                    out += [(key, s, e, other, t, u) for s, e, t, u in found]
                    continue
                x, y = (p - max(step, 0) for p in path[0])  # the last equal words
                if more := beyond(grown(*map(numbered, sides), x, y, step), x, y):
                    (x, y), (u, v) = (path[0], more[-1]) if step > 0 else (more[-1], path[0])
                    out.append((key, x, u + max(step, 0), other, y, v + max(step, 0)))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.int32()] * 2, strict=True)], names=["key", "start", "end", "other", "other_start", "other_end"])

    found = materialise(rows.mapInArrow(run, "key long, start int, end int, other long, other_start int, other_end int"), "aligned")
    discard(wanted, have)
    return found


def found_on(docs: DataFrame, met: DataFrame) -> DataFrame:
    """Passages of pairs of texts on the chains of their matches."""
    linked = materialise(chains(met), "chains")
    proved = linked.select("key", "other", F.explode("proved").alias("p")).select("key", "other", "p.*")
    todo = linked.select("key", "other", F.explode("todo").alias("path"), F.lit(0).alias("step"))
    todo = materialise(todo.unionByName(ends_of(proved)), "to-align")
    more = aligned(docs, todo)
    columns = ["key", "start", "end", "other", "other_start", "other_end"]
    found = materialise(proved.select(*columns).unionByName(more.select(*columns)), "passages")
    discard(linked, todo, more)
    return found


def repeated(docs: DataFrame) -> DataFrame:
    """Documents that share passages: doc_id, n_words, n_repeated, n_passages, spans, class_id.

    spans: joined word ranges start:end; class_id: smallest doc_id reachable over shared
    passages and equal texts, itself included.
    """
    with shuffles_freed(docs.sparkSession):
        return _repeated(docs)


def _repeated(docs: DataFrame) -> DataFrame:
    none = F.array().cast("array<struct<start:int,end:int>>")
    shared = seed_counts(docs)
    held = materialise(places(docs, shared), "places")
    texts = materialise(held.select("doc_id", "key", "n_words"), "texts")
    met = materialise(matches(held, shared), "matches")
    crowd = materialise(held.select(F.explode("spots.seed").alias("seed")).groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD), "crowded-seeds")
    discard(held)
    found = found_on(docs, met)
    # the stars of crowded seeds leave pairs out: all those that can add a passage
    rest = materialise(crowded_matches(docs, shared, crowd, found), "crowded-matches")
    discard(shared)
    if rest.limit(1).count():
        pairs = rest.select("key", "other").distinct()
        found = found.unionByName(found_on(docs, rest.unionByName(met.join(pairs, ["key", "other"], "left_semi"))))
    discard(met, rest)
    ranges = both_ways(found).select("key", "start", "end").distinct().groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    own = texts.groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("n_words").alias("n_words"))
    copies = F.when(F.col("n") > 1, F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").alias("end")))).otherwise(none)
    held = own.join(ranges, "key", "left").withColumn("ranges", F.array_sort(F.concat(F.coalesce("ranges", none), copies))).where("size(ranges) > 0")
    classes = components(found.select(F.col("key").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "key")
    held = materialise(held.join(classes, "key", "left").withColumn("component", F.coalesce("component", "key")), "holders")
    names = held.groupBy("component").agg(F.min("least").alias("class_id"))

    def add(acc, r):
        last = F.try_element_at(acc, F.lit(-1))
        touch = F.coalesce(r["start"] <= last["end"], F.lit(False))
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))))
        return F.when(touch, grown).otherwise(F.concat(acc, F.array(r)))

    facts = held.join(materialise(names, "passage-classes"), "component").select("key", F.col("n_words").cast("long").alias("n_words"), F.aggregate("ranges", none, add).alias("spans"), "class_id")
    facts = facts.select(
        "key",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda s, r: s + (r["end"] - r["start"])).alias("n_repeated"),
        F.size("spans").cast("long").alias("n_passages"),
        F.array_join(F.transform("spans", lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string"))), ",").alias("spans"),
        "class_id",
    )
    return texts.select("doc_id", "key").join(materialise(facts, "repeats"), "key").drop("key")

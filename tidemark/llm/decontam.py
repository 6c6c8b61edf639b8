"""Benchmark decontamination with a generalised suffix automaton over words.

The normalised benchmark items are put into one suffix automaton. Every document's
words are streamed through it; the length of the longest match that ends at each
word tells which windows of an item (13 consecutive words; the whole item if it is
shorter) end there, and the state tells in which items. Words inside such windows
are hit.

Words of a document that are no part of a run of word pairs known from the items
can't be in a window of two or more words; a bit table of hashed pairs (no false
negatives) skips them before the automaton.

Items never come to the driver. They are written to the shared folder, dealt by hash of
their text into groups of about ``most_words`` words, and a task reads one group and builds
its automaton. One group takes one pass over the documents. More groups take one pass each,
one after the other, that writes the rows with hits; a row's spans and items are then put
together. So a worker holds one automaton at a time, of ``most_words`` words (an item is
never cut: one longer than that is its group's size), whatever the size of the benchmark.

Defined cases: null or wordless texts have no words and are not contaminated; null item
texts and wordless items are no items; items with equal ids count once. Items without an
id count like items of one more id: their windows are hit, n_items counts them as one,
and the digest of the ids leaves them out. Documents with a null doc_id and repeated rows
are judged like any other, each row by itself; texts of any length are streamed whole; an
empty table gives no rows, an empty benchmark no hits; columns that are carried along may
have any name.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import filesystem, materialise, slices_of, small_batches, work_path

WINDOW = 13
#: Bytes outside of words become blanks; A-Z become a-z.
_KEPT = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
_TABLE = bytes(b if b in _KEPT else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def blanked(text: str | None) -> bytes:
    """The text in lower case with a blank for every byte outside of words."""
    return text.encode().translate(_TABLE) if text else b""


def words_of(text: str | None) -> list[bytes]:
    return blanked(text).split()


class Automaton:
    """Generalised suffix automaton of word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.shortest = window
        seqs = []
        for item, words in items:
            if not words:
                continue
            seq = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            seqs.append((item, seq))
            self.shortest = min(self.shortest, len(seq))
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self._mark(seqs)
        self.bits = 1 << max(16, (4 * sum(len(s) for _, s in seqs)).bit_length() + 2)
        self.known = np.zeros(self.bits, bool)
        for _, s in seqs:
            if len(s) > 1:
                a = np.array(s, np.int64)
                self.known[self._pair(a[:-1], a[1:])] = True

    def _pair(self, a, b):
        return ((a * 0x9E3779B1 + b * 0x85EBCA6B) >> 3) & (self.bits - 1)

    def _new(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.len.append(length)
        self.next.append(nxt)
        self.link.append(link)
        return len(self.len) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state for the strings of q that are no longer than p's and c."""
        clone = self._new(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, q, c)
        cur, p = self._new(self.len[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, c)
        return cur

    def _home(self, state: int, length: int) -> int:
        """The state among the suffix links of ``state`` that holds its suffix of that length."""
        while self.len[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _mark(self, seqs) -> None:
        self.items: dict[int, set] = {}
        whole: dict[int, list[tuple[int, int]]] = {}
        for item, seq in seqs:
            state, n = 0, 0
            for c in seq:
                state, n = self.next[state][c], n + 1
                if n > self.window:
                    state = self._home(state, self.window)
                    n = self.window
                if n == self.window:
                    self.items.setdefault(self._home(state, self.window), set()).add(item)
            if len(seq) < self.window:
                whole.setdefault(state, []).append((len(seq), item))
        #: Short items that end where a state ends: own ones first need the length.
        self.short: dict[int, list[tuple[int, int]]] = {}
        if whole:
            for s in sorted(range(1, len(self.len)), key=self.len.__getitem__):
                if found := whole.get(s, []) + self.short.get(self.link[s], []):
                    self.short[s] = found

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit word ranges (start, end exclusive; disjoint, ascending) and the items."""
        if len(words) < self.shortest or not self.vocab:
            return [], set()
        ids = np.fromiter(map(self.vocab.get, words, [-1] * len(words)), np.int64, len(words))
        if self.shortest > 1:
            ok = (ids[:-1] >= 0) & (ids[1:] >= 0)
            ok &= self.known[self._pair(ids[:-1], ids[1:])]
            more = 1
        else:
            ok, more = ids >= 0, 0
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ok, [False])).astype(np.int8)))
        out: list[tuple[int, int]] = []
        items: set = set()
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a + more >= self.shortest:
                self._stream(ids[a : b + more].tolist(), a, out, items)
        return out, items

    def _stream(self, ids: list[int], at: int, out: list, items: set) -> None:
        nxt, link, lens, window = self.next, self.link, self.len, self.window
        state = n = 0
        for i, c in enumerate(ids):
            while state and c not in nxt[state]:
                state = link[state]
                n = lens[state]
            to = nxt[state].get(c)
            if to is None:
                state = n = 0
                continue
            state, n = to, n + 1
            hit = 0
            if n >= window:
                hit = window
                items |= self.items[self._home(state, window)]
            for m, item in self.short.get(state, ()):
                if n >= m:
                    hit = max(hit, m)
                    items.add(item)
            if hit:
                a, b = at + i + 1 - hit, at + i + 1
                while out and out[-1][1] >= a:
                    a = min(a, out.pop()[0])
                out.append((a, b))


_built: dict[tuple[str, int], Automaton] = {}


def automaton(path: str, window: int) -> Automaton:
    """The automaton of a written group of items; a worker keeps the last one."""
    if (path, window) not in _built:
        _built.clear()
        fs, root = filesystem(path)
        rows = ds.dataset(root, filesystem=fs, format="parquet").to_table(columns=["item", "text"]) if fs.get_file_info(root).type else None
        items = [] if rows is None else sorted(((i, words_of(t)) for i, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)), key=lambda x: (x[0] is None, x[0] or "", x[1]))
        _built[path, window] = Automaton(items, window)
    return _built[path, window]


def item_groups(benchmark: DataFrame, most_words: int) -> list[str]:
    """Folders of the items (item, text), dealt by hash into groups of about ``most_words`` words."""
    words = F.regexp_count("text", F.lit("[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where(F.col("text").isNotNull()).distinct()
    total = items.agg(F.sum(words)).first()[0] or 0
    n = max(1, -(-total // most_words))
    folder = work_path(benchmark.sparkSession, "benchmark")
    # a file for each group: a task writes the rows of its groups in turn
    items.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")).repartition("part").write.partitionBy("part").parquet(folder)
    return [f"{folder}/part={i}" for i in range(n)]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS = "array<struct<a:int,b:int>>"
_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def scan(rows: DataFrame, path: str, window: int, every: bool) -> DataFrame:
    """n_words, spans and items for rows (row, text); only the rows with hits unless ``every``."""

    def run(batches):
        a = automaton(path, window)
        for batch in batches:
            for b in slices_of(batch, 1):
                at, n, spans, found = [], [], [], []
                for i, text in enumerate(b.column(1)):
                    words = words_of(text.as_py())
                    s, items = a.spans(words)
                    if s or every:
                        at.append(i)
                        n.append(len(words))
                        spans.append([{"a": x, "b": y} for x, y in s])
                        found.append(sorted(x for x in items if x is not None) + [None] * (None in items))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(n, pa.int64()), pa.array(spans, _SPANS), pa.array(found, pa.list_(pa.string()))], names=["row", "n_words", "spans", "items"])

    kind = StructType([rows.schema["row"], *StructType.fromDDL(f"n_words long, spans {SPANS}, items array<string>").fields])
    return rows.mapInArrow(run, kind)


def united(hits: DataFrame) -> DataFrame:
    """One row for each number of hits (row, spans, items) in several groups of items."""
    lists = hits.groupBy(F.col("row").alias("number")).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))

    def run(batches):
        for b in batches:
            spans = [[{"a": x, "b": y} for x, y in merge([(s["a"], s["b"]) for s in part])] for part in b.column(1).to_pylist()]
            items = [sorted({x for x in part if x is not None}) + [None] * (None in part) for part in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], names=["number", "spans", "items"])

    return lists.mapInArrow(run, f"number long, spans {SPANS}, items array<string>")


def find_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_words: int = 500_000, carry: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """row (a struct of the ``carry`` columns), n_words, spans (hit word ranges), items (ids, ascending as strings; at the end null for items without one)."""
    rows = small_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), "text")
    groups = item_groups(benchmark, most_words)
    if len(groups) == 1:
        return scan(rows, groups[0], window, True)
    kept = materialise(rows.withColumn("number", F.monotonically_increasing_id()), "documents-to-scan")
    numbered = kept.select(F.col("number").alias("row"), "text")
    sized = materialise(scan(numbered, groups[0], window, True), "benchmark-hits")
    hits = sized.where("size(spans) > 0")
    for path in groups[1:]:
        hits = hits.unionByName(materialise(scan(numbered, path, window, False), "benchmark-hits"))
    found = materialise(united(hits.select("row", "spans", "items")), "benchmark-hits")
    out = kept.select("number", "row").join(sized.select(F.col("row").alias("number"), "n_words"), "number").join(found, "number", "left")
    return out.select("row", "n_words", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def judge(found: DataFrame, least_share: float = 0.05) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated to what find_spans gives."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["b"] - s["a"]).cast("long"))
    share = Fraction(str(least_share))  # in whole numbers, so that nothing is rounded
    enough = F.lit(share.denominator) * F.col("n_hit") >= F.lit(share.numerator) * F.col("n_words")
    return found.withColumn("n_hit", hit).select(
        "*",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & enough).alias("contaminated"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document: how much of it stands in windows of benchmark items."""
    found = judge(find_spans(docs, benchmark, carry=("doc_id",)))
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, that aren't contaminated."""
    return judge(find_spans(docs, benchmark, carry=tuple(docs.columns))).where("not contaminated").select("row.*")


def excise(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    data = text.encode()
    marked = data.translate(_TABLE)
    places, at = [], 0
    for w in marked.split():
        at = marked.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    out, last = [], 0
    for a, b in spans:
        out.append(data[last : places[a][0]])
        last = places[b - 1][1]
    return b"".join([*out, data[last:]]).decode()


def remove_spans(docs: DataFrame, benchmark: DataFrame, longest: int = 0) -> DataFrame:
    """doc_id and text without the hit spans of more than ``longest`` words."""

    def run(batches):
        for b in batches:
            out = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                cut = [(s["a"], s["b"]) for s in spans if s["b"] - s["a"] > longest]
                out.append(excise(text, cut) if cut else text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return find_spans(docs, benchmark).select("row.doc_id", "row.text", "spans").mapInArrow(run, "doc_id long, text string")

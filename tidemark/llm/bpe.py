"""Byte-level BPE by merge replay over the vocabulary of a corpus.

The pre-tokenising pattern cuts texts into words, once. A task deals its texts into slices
of about ``SLICE`` bytes and writes each as numbers: a word that is a token itself by its
rank, which hides the frequent words from everything below, any other by its place in the
slice's own list of distinct words. These lists, dealt into buckets by hash of the word, are
the vocabulary of the corpus: a bucket holds all that any slice has of its words. There are
so many buckets that one has about ``BUCKET`` bytes of text behind it, but ``BUCKETS`` at
most, so a slice never sends more rows than that and each bucket gets about as many rows and
words as any other. A bucket is read as a stream of chunks of about ``CHUNK`` bytes of words.
The words of a chunk that the bucket hasn't seen are replayed at once, each word of the
corpus just once (again only where a bucket has over ``VOCABULARY`` bytes of distinct words,
and its memo starts anew): they form one flat array of symbols, an
inverted index leads from the pairs that can merge to the positions where they stand, and
merges are applied in rank order to all words at once, updating only the two neighbours of
each merged pair. Pairs that make the same token have the same rank and share an entry,
for of them the leftmost goes first. The ids go back to the slices, whose tasks lay out
the ids of the texts. Only lists of distinct words and their ids are shuffled, never
texts.

Decoding starts from the ids alone.

Defined cases: null and empty texts have no ids and decode to no bytes; rows with a null
doc_id and repeated rows are encoded like any other, each row by itself; a longer text is a
slice of its own, whole; an empty table gives no rows; pairs of one rank merge from the left;
of the documents only the id and the text are read, other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
import uuid
import zlib
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import filesystem, materialise, slices_of, small_batches, work_path


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def byte_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    """Merge rank of each pair of bytes (first << 8 | second), -1 for none."""
    return np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64)


def replay(words: list[bytes], ranks: dict[bytes, int], tokens: list[bytes], pairs: dict[int, int], first: np.ndarray) -> tuple[list[int], list[int]]:
    """Ids of all words on end, and where each word ends among them.

    ``tokens``: bytes by id; ``pairs``: memo of pair to merge rank, -1 for none;
    ``first``: byte_pairs(ranks).
    """
    data = np.frombuffer(b"".join(words), np.uint8)
    if not len(data):
        return [], [0] * len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    n = len(data)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    lasts = ends[ends > 0] - 1
    after[lasts] = -1
    before[lasts[lasts < n - 1] + 1] = -1
    start = first[data[:-1].astype(np.int64) << 8 | data[1:]]
    start[lasts[lasts < n - 1]] = -1
    at = np.flatnonzero(start >= 0)
    at = at[np.argsort(start[at], kind="stable")]
    heap, cuts = np.unique(start[at], return_index=True)
    # the inverted index: merge rank to the positions of its pairs, and the ranks as a heap
    index = dict(zip(heap.tolist(), (x.tolist() for x in np.split(at, cuts[1:])), strict=True)) if len(at) else {}
    heap = heap.tolist()
    sym = np.array([ranks[bytes([b])] for b in range(256)])[data].tolist()
    nxt, prv = after.tolist(), before.tolist()
    known, spot = pairs.get, index.get

    while heap:
        r = heappop(heap)
        places = index.pop(r, None)
        if places is None:
            continue
        places.sort()
        merged = tokens[r]
        for i, p in enumerate(places):
            q = nxt[p]
            if q < 0:
                continue
            a, b = sym[p], sym[q]
            if a < 0:
                continue
            key = a << 24 | b
            t = known(key)
            if t is None:
                t = pairs[key] = ranks.get(tokens[a] + tokens[b], -1)
            if t != r:
                continue
            sym[p], sym[q] = r, -1
            low = r
            nxt[p] = q = nxt[q]
            if q >= 0:
                prv[q] = p
                key = r << 24 | sym[q]
                t = known(key)
                if t is None:
                    t = pairs[key] = ranks.get(merged + tokens[sym[q]], -1)
                if t >= 0:
                    if (there := spot(t)) is None:
                        index[t] = [p]
                        heappush(heap, t)
                    else:
                        there.append(p)
                    if t < low:
                        low = t
            q = prv[p]
            if q >= 0:
                key = sym[q] << 24 | r
                t = known(key)
                if t is None:
                    t = pairs[key] = ranks.get(tokens[sym[q]] + merged, -1)
                if t >= 0:
                    if (there := spot(t)) is None:
                        index[t] = [q]
                        heappush(heap, t)
                    else:
                        there.append(q)
                    if t < low:
                        low = t
            if low < r:  # a pair of lower rank has come up: it goes first, as in each word alone
                if rest := places[i + 1 :]:
                    index[r] = rest + index.get(r, [])
                    heappush(heap, r)
                break
    ids = np.array(sym)
    alive = ids >= 0
    return ids[alive].tolist(), np.concatenate(([0], np.cumsum(alive)))[ends].tolist()


class Codec:
    """Ids of words and bytes of ids."""

    MOST_PAIRS = 2_000_000

    def __init__(self, rank_file: str, pattern: str):
        self.ranks = load_ranks(rank_file)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, r in self.ranks.items():
            self.tokens[r] = token
        self.single = [[r] for r in range(len(self.tokens))]
        self.first = byte_pairs(self.ranks)
        self.split = regex.compile(pattern).findall
        self.pairs: dict[int, int] = {}

    def words(self, whole: list[bytes]) -> list[list[int]]:
        """The ids of each word: its own if it is a token, else by replay of all such words at once."""
        if len(self.pairs) > self.MOST_PAIRS:
            self.pairs = {}
        rest = [w for w in whole if w not in self.ranks]
        ids, ends = replay(rest, self.ranks, self.tokens, self.pairs, self.first)
        parts = (ids[a:b] for a, b in itertools.pairwise([0, *ends]))
        return [[r] if (r := self.ranks.get(w)) is not None else next(parts) for w in whole]

    def encode(self, text: str | None) -> list[int]:
        return list(itertools.chain.from_iterable(self.words([w.encode() for w in self.split(text)]))) if text else []

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_codecs: dict[tuple, Codec] = {}


def codec(rank_file: str, pattern: str) -> Codec:
    key = (rank_file, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


#: Bytes of text in a slice, and behind a bucket of words; most buckets.
SLICE, BUCKET, BUCKETS = 8_000_000, 4_000_000, 4096
#: Bytes of words that a bucket's task takes at once, and that it remembers; a word counts as ``EACH`` bytes more.
CHUNK, VOCABULARY, EACH = 8_000_000, 64_000_000, 64


def packed(x: np.ndarray) -> bytes:
    """Whole numbers, their low bytes first, then the next, and so on, compressed."""
    planes = x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return struct.pack("<Q", len(x)) + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<Q", data)
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<i8").ravel()


def packed_words(words: list[bytes]) -> bytes:
    sizes, whole = packed(np.fromiter(map(len, words), np.int64, len(words))), b"".join(words)
    return struct.pack("<QQ", len(sizes), len(whole)) + sizes + pa.compress(whole, codec="zstd", asbytes=True)


def unpacked_words(data: bytes) -> list[bytes]:
    n, size = struct.unpack_from("<QQ", data)
    ends = np.cumsum(unpacked(data[16 : 16 + n])).tolist()
    whole = pa.decompress(data[16 + n :], decompressed_size=size, codec="zstd", asbytes=True)
    return [whole[a:b] for a, b in itertools.pairwise([0, *ends])]


def slices(docs: DataFrame, rank_file: str, pattern: str, folder: str, buckets: int) -> DataFrame:
    """slice, file, bucket, base, words: the distinct words of each slice that aren't tokens, by bucket, numbered from base on.

    The texts go to the file as numbers of words: ranks, and above them all places in these lists. Slices are numbered by partition; files
    carry a name of their attempt, and only those of tasks that succeeded are listed. The
    first row of a slice has bucket -1, the file's name and the number of words as base.
    """
    names = ["slice", "file", "bucket", "base", "words"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches):
        c, (fs, root) = codec(rank_file, pattern), filesystem(folder)
        split, rank, least = c.split, c.ranks.get, len(c.tokens)
        pid, made = TaskContext.get().partitionId(), 0
        ids: list = []
        counts, numbers, size = [], [], 0
        known: dict[str, int] = {}
        words: list[bytes] = []

        def close():
            nonlocal made, size
            of = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            order = np.argsort(of, kind="stable")
            place = np.arange(least + len(words))
            place[least + order] = least + np.arange(len(words))
            name = f"{pid}-{made}-{uuid.uuid4().hex}"
            # null ids stand as zero and are told by the second part
            with fs.open_output_stream(f"{root}/{name}") as f:
                for part in ([i or 0 for i in ids], [i is None for i in ids], counts, place[np.array(numbers, np.int64)]):
                    part = packed(np.array(part, np.int64))
                    f.write(struct.pack("<Q", len(part)) + part)
            rows = [(pid << 32 | made, name, -1, len(words), None)]
            found, first = np.unique(of[order], return_index=True)
            for bucket, (x, y) in zip(found.tolist(), itertools.pairwise([*first.tolist(), len(words)]), strict=True):
                rows.append((pid << 32 | made, None, bucket, x, packed_words([words[i] for i in order[x:y].tolist()])))
            made, size = made + 1, 0
            for x in (ids, counts, numbers, known, words):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for b in slices_of(batch, 1):
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    text = text.as_py()
                    if ids and size + len(text or "") > SLICE:
                        yield close()
                    said = split(text) if text else []
                    for w in set(said).difference(known):
                        whole = w.encode()
                        if (r := rank(whole)) is None:
                            r = least + len(words)
                            words.append(whole)
                        known[w] = r
                    numbers += map(known.__getitem__, said)
                    ids.append(doc_id)
                    counts.append(len(said))
                    size += len(text or "")
        if ids:
            yield close()

    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    return docs.mapInArrow(run, "slice long, file string, bucket int, base int, words binary")


def load(fs, path: str) -> tuple[list, np.ndarray, np.ndarray]:
    """Ids, numbers of words and words' numbers of the texts of a slice."""
    with fs.open_input_file(path) as f:
        data = f.read()
    parts, at = [], 0
    while at < len(data):
        (n,) = struct.unpack_from("<Q", data, at)
        parts.append(unpacked(data[at + 8 : at + 8 + n]))
        at += 8 + n
    ids, none, counts, numbers = parts
    return [None if missing else i for i, missing in zip(ids.tolist(), none.tolist(), strict=True)], counts, numbers


def replayed(lists: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """slice, base, sizes, ids of the lists of words: how many ids each word has, and these on end, packed."""

    def run(batches):
        c, none = codec(rank_file, pattern), np.empty(0, np.int64)
        now, rows, held = None, [], 0
        known, fresh, size = {}, [], 0
        sizes, flat = none, none

        def close():
            nonlocal held, sizes, flat
            ids = c.words(fresh)
            sizes = np.concatenate([sizes, np.fromiter(map(len, ids), np.int64, len(ids))])
            flat = np.concatenate([flat, np.fromiter(itertools.chain.from_iterable(ids), np.int64)])
            first = np.cumsum(sizes) - sizes
            out = ([], [], [], [])
            for key, base, words in rows:
                n = sizes[words]
                at = np.repeat(first[words] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                for x, v in zip(out, (key, base, packed(n), packed(flat[at])), strict=True):
                    x.append(v)
            rows.clear()
            fresh.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["slice", "base", "sizes", "ids"])

        for b in batches:
            for bucket, key, base, words in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if rows and (bucket != now or held > CHUNK):
                    yield close()
                if not rows and (bucket != now or size > VOCABULARY):
                    known.clear()
                    size, sizes, flat = 0, none, none
                now = bucket
                words = unpacked_words(words)
                for w in words:
                    if w not in known:
                        known[w] = len(known)
                        fresh.append(w)
                        size += len(w) + EACH
                held += sum(map(len, words)) + EACH * len(words)
                rows.append((key, base, np.fromiter(map(known.__getitem__, words), np.int64, len(words))))
        if rows:
            yield close()

    words = lists.where("bucket >= 0").select("bucket", "slice", "base", "words").repartition("bucket").sortWithinPartitions("bucket")
    return words.mapInArrow(run, "slice long, base int, sizes binary, ids binary")


def encoded(docs: DataFrame, rank_file: str, pattern: str, finish, schema: str) -> DataFrame:
    """What ``finish(codec, doc_ids, counts of words, numbers of words, ids of each word)`` makes of each slice of docs (doc_id, text)."""
    folder = work_path(docs.sparkSession, "word-numbers")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    lists = materialise(slices(docs, rank_file, pattern, folder, min(BUCKETS, max(1, -(-total // BUCKET)))), "word-lists")
    given = replayed(lists, rank_file, pattern).withColumns({"file": F.lit(None).cast("string"), "n": F.lit(0)})
    none = F.lit(None).cast("binary")
    heads = lists.where("bucket < 0").select("slice", F.lit(-1).alias("base"), none.alias("sizes"), none.alias("ids"), "file", F.col("base").alias("n"))

    def run(batches):
        c, (fs, root) = codec(rank_file, pattern), filesystem(folder)
        file, n, sizes, ids = None, 0, [], []

        def close():
            counts = np.concatenate([np.empty(0, np.int64), *map(unpacked, sizes)])
            if len(counts) != n:
                raise ValueError(f"{len(counts)} of {n} words of {file} have ids")
            flat, ends = list(itertools.chain.from_iterable(unpacked(x).tolist() for x in ids)), np.cumsum(counts).tolist()
            return finish(c, *load(fs, f"{root}/{file}"), c.single + [flat[a:b] for a, b in itertools.pairwise([0, *ends])])

        for b in batches:
            for base, some, part, name, words in zip(*(b.column(j).to_pylist() for j in range(5)), strict=True):
                if base >= 0:
                    sizes.append(some)
                    ids.append(part)
                    continue
                if file is not None:
                    yield from close()
                file, n, sizes, ids = name, words, [], []
        if file is not None:
            yield from close()

    # what a task reads from files is far more than what it is sent, so its share isn't to be coalesced
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = given.unionByName(heads).repartition(n, "slice").sortWithinPartitions("slice", "base")
    return rows.select("base", "sizes", "ids", "file", "n").mapInArrow(run, schema)


def encode_column(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of every whole text."""

    def finish(c, doc_ids, counts, numbers, of_word):
        at = 0
        for doc_id, n in zip(doc_ids, counts.tolist(), strict=True):
            ids = list(itertools.chain.from_iterable(map(of_word.__getitem__, numbers[at : at + n].tolist())))
            at += n
            yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return encoded(small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), rank_file, pattern, finish, "doc_id long, ids array<int>")


def decode_column(tokens: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, decoded (binary) of doc_id, ids."""

    def run(batches):
        c = codec(rank_file, pattern)
        for b in batches:
            out = [c.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def digests(c: Codec, doc_ids: list, counts: np.ndarray, numbers: np.ndarray, of_word: list[list[int]]):
    """doc_id, n_tokens and digests of the ids and of the bytes they decode to, of the texts of a slice."""
    decimals = [",".join(map(str, x)) for x in of_word]
    n, of_ids, of_bytes, at = [], [], [], 0
    for count in counts.tolist():
        part = numbers[at : at + count].tolist()
        at += count
        ids = list(itertools.chain.from_iterable(map(of_word.__getitem__, part)))
        n.append(len(ids))
        of_ids.append(hashlib.sha256(",".join(map(decimals.__getitem__, part)).encode()).hexdigest())
        of_bytes.append(hashlib.sha256(c.decode(ids)).hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), *[pa.array(x, pa.string()) for x in (of_ids, of_bytes)]], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip_digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Encode and decode every text; digests of the ids and of the decoded bytes.

    doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of
    the bytes of those ids). Only digests leave the task, whatever the length of a text.
    """
    docs = small_batches(docs).select(F.col("doc_id").cast("long"), "text")
    return encoded(docs, rank_file, pattern, digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

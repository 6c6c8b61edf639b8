"""Token ids in length-delimited binary record files with an offset index.

File format (little endian). A record file is a run of records:

    u64 length | u32 masked crc of the length | payload | u32 masked crc of the payload
    payload: i64 doc_id | u32 flags (1: doc_id is null) | u32 bytes per id (2 or 4) | ids

The mask rotates the CRC-32 right by 15 bits and adds 0xa282ead8, so that a
checksum over data that holds checksums stays sound. The index file beside it has
one row of three u64 per record: offset in the file, number of ids, ids before it
in the file. ``manifest.json`` lists the files in order with the ids before each.

Defined cases: null and empty texts are encoded as the end id alone; a null doc_id
sorts first; equal doc_ids are ordered by a hash of their text; an empty table
gives no files and no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
import random
import re
import string
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.llm.common import filesystem, slices_of

MASK_DELTA = 0xA282EAD8
INDEX_ROW = np.dtype([("offset", "<u8"), ("n", "<u8"), ("before", "<u8")])
HEAD = "<qII"
HEAD_SIZE = struct.calcsize(HEAD)
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return b"".join((n, struct.pack("<I", masked_crc(n)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: memoryview, at: int) -> tuple[memoryview, int]:
    """The payload at an offset and the next record's offset; ValueError if damaged."""
    n = bytes(data[at : at + 8])
    (length,), (crc,) = struct.unpack("<Q", n), struct.unpack("<I", data[at + 8 : at + 12])
    if masked_crc(n) != crc:
        raise ValueError(f"damaged length at {at}")
    payload = data[at + 12 : at + 12 + length]
    (crc,) = struct.unpack("<I", data[at + 12 + length : at + 16 + length])
    if masked_crc(payload) != crc:
        raise ValueError(f"damaged payload at {at}")
    return payload, at + 16 + length


class WordEncoder:
    """Encodes whole texts with a tokenizer of the tokenizers library that drops white
    space, by encoding each distinct piece between blanks and line ends once.

    Such a tokenizer never joins, normalises or merges across white space, so pieces
    are independent; a tokenizer for which this doesn't hold is refused.
    """

    MOST_PIECES, MOST_CHARS = 900_000, 14_000_000
    MARKS = string.punctuation

    def __init__(self, tokenizer_file: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_file)
        self.slim = self.slimmed(Tokenizer)
        if self.tok.encode("a b", add_special_tokens=False).ids != [
            *self.tok.encode("a", add_special_tokens=False).ids,
            *self.tok.encode("b", add_special_tokens=False).ids,
        ]:
            raise ValueError("this tokenizer keeps white space: pieces are not independent")
        self.dtype = np.dtype("<u2" if max(self.tok.get_vocab_size(True), end_id + 1) <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.dtype).tobytes()
        self.cache: dict[str, bytes] = {"": b""}
        self.chars = 0

    def slimmed(self, kind):
        """The same model for words that are letters in their final form, or None.

        Where the tokenizer composes (NFC), blanks white space, lower-cases, splits off
        runs of letters and maps bytes, only the last is left to do for such words.
        """
        spec = json.loads(self.tok.to_str())
        known = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if (spec["normalizer"] or {}).get("normalizers") != known or [x["type"] for x in steps] != ["Split", "ByteLevel"] or "[\\p{L}]+|" not in str(steps[0]["pattern"].get("Regex")):
            return None
        spec |= {"normalizer": None, "pre_tokenizer": steps[1], "added_tokens": []}
        return kind.from_str(json.dumps(spec))

    def parts(self, pieces: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """For each piece a head and a tail with the same ids on end, and whether the head is final.

        Marks at the end of letters are a word of their own, and letters have the ids of
        their composed lower case; other pieces are heads as they are.
        """
        if self.slim is None or not len(pieces):
            return pieces, pa.array([""] * len(pieces), pa.string()), pa.array([False] * len(pieces))
        body = pc.ascii_rtrim(pieces, self.MARKS)
        final = pc.utf8_lower(pc.utf8_normalize(body, "NFC"))
        # one letter alone has a lower case of two characters, of which one is a mark
        plain = pc.and_(pc.and_(pc.utf8_is_alpha(body), pc.utf8_is_alpha(final)), pc.invert(pc.match_substring(body, "\u0130")))
        tail = pc.struct_field(pc.extract_regex(pieces, f"(?P<t>[{re.escape(self.MARKS)}]*)$"), "t")
        return pc.if_else(plain, final, pieces), pc.if_else(plain, tail, ""), plain

    def known(self, words: list[str], final) -> list[bytes]:
        """Ids of distinct strings; those that are ``final`` go to the plain model."""
        cache = self.cache
        found = list(map(cache.get, words))
        lacking = [i for i, ids in enumerate(found) if ids is None]
        for tok, at in ((self.slim, [i for i in lacking if final[i]]), (self.tok, [i for i in lacking if not final[i]])):
            if at:
                got = tok.encode([words[i] for i in at], is_pretokenized=True, add_special_tokens=False)
                ends = (np.cumsum(np.bincount(np.array(got.word_ids, np.int64), minlength=len(at))) * self.dtype.itemsize).tolist()
                data, last = np.array(got.ids, self.dtype).tobytes(), 0
                for i, end in zip(at, ends, strict=True):
                    found[i] = cache[words[i]] = data[last:end]
                    self.chars += len(words[i])
                    last = end
        return found

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Ids of each text with the end id, as bytes of ``dtype``.

        Arrow cuts the texts and numbers their distinct pieces; only those are looked up,
        and numpy lays their ids out for every occurrence.
        """
        if len(self.cache) > self.MOST_PIECES or self.chars > self.MOST_CHARS:
            self.cache, self.chars = {"": b""}, 0
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        cut = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        pieces = cut.flatten().dictionary_encode()
        head, tail, final = self.parts(pieces.dictionary)
        # a string may be final in one piece and as it is in another: only letters are final, and those have equal ids
        head, tail = head.dictionary_encode(), tail.dictionary_encode()
        finals = np.zeros(len(head.dictionary), bool)
        finals[head.indices.to_numpy()[np.asarray(final)]] = True
        found = self.known(head.dictionary.to_pylist(), finals.tolist()) + self.known(tail.dictionary.to_pylist(), [False] * len(tail.dictionary))
        lens = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        firsts, ids = np.cumsum(lens) - lens, np.frombuffer(b"".join(found), self.dtype)
        both = np.stack((head.indices.to_numpy(), tail.indices.to_numpy() + len(head.dictionary)), 1)
        which = both[pieces.indices.to_numpy()].ravel()  # head and tail of each occurrence
        counts = lens[which]
        ends = np.cumsum(counts)
        flat = ids[np.repeat(firsts[which] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate(([0], ends))[2 * (cut.offsets.to_numpy() - cut.offsets[0].as_py())].tolist()
        return [flat[a:b].tobytes() + self.end for a, b in zip(bounds, bounds[1:], strict=False)]


_encoders: dict[tuple, WordEncoder] = {}


def encoder(tokenizer_file: str, end_id: int) -> WordEncoder:
    """One for each Python worker."""
    key = (tokenizer_file, end_id)
    if key not in _encoders:
        _encoders[key] = WordEncoder(*key)
    return _encoders[key]


def write_token_records(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encode every text and write the ids in ascending id order; returns the manifest.

    One range shuffle on (id, hash of the text) orders the rows, so that repeated ids
    can be split too. Each task writes files under a name of its own attempt; only the
    names that successful tasks return come into the manifest, so retries and lost
    executors leave no half-written file in it. Files of this run's other attempts are deleted,
    files of anyone else stay. The driver gets one row for each task.
    """
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    run = uuid.uuid4().hex
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("_tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "_tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_tie", "text")

    def write(batches):
        from pyspark import TaskContext

        enc, out, n_docs, n_ids, offset = encoder(tokenizer_file, end_id), None, 0, 0, 0
        fs, root = filesystem(folder)
        pid = TaskContext.get().partitionId()
        name = f"part-{run}-{pid:08d}-{uuid.uuid4().hex}"
        index = None
        for batch in batches:
            for part in slices_of(batch, 1, 4_000_000):
                if out is None:
                    out, index = fs.open_output_stream(f"{root}/{name}.rec"), fs.open_output_stream(f"{root}/{name}.idx")
                written, places = [], []
                for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1)), strict=True):
                    record = frame(struct.pack(HEAD, 0 if doc_id is None else doc_id, doc_id is None, enc.dtype.itemsize) + ids)
                    n = len(ids) // enc.dtype.itemsize
                    written.append(record)
                    places.append((offset, n, n_ids))
                    offset, n_ids, n_docs = offset + len(record), n_ids + n, n_docs + 1
                out.write(b"".join(written))
                index.write(np.array(places, INDEX_ROW).tobytes())
        if out is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"pid": [pid], "name": [name], "docs": [n_docs], "ids": [n_ids]})

    parts = sorted(rows.select("doc_id", "text").mapInArrow(write, "pid long, name string, docs long, ids long").collect(), key=lambda r: r.pid)
    files, start = [], 0
    for r in parts:
        files.append({"name": r.name, "docs": r.docs, "ids": r.ids, "start": start})
        start += r.ids
    kept = {f"{f['name']}.{kind}" for f in files for kind in ("rec", "idx")}
    from pyarrow.fs import FileSelector

    for info in fs.get_file_info(FileSelector(root)):
        if info.base_name.startswith(f"part-{run}-") and info.base_name not in kept:  # of attempts that failed
            fs.delete_file(info.path)
    manifest = {"docs": sum(f["docs"] for f in files), "ids": start, "files": files}
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


class _File(InputPartition):
    def __init__(self, name: str, start: int):
        self.name, self.start = name, start


class TokenRecordReader(DataSourceReader):
    """Options: path; seed: read the records of each file in a shuffled order, by the index."""

    def __init__(self, options):
        self.path, seed = options["path"], options.get("seed")
        self.seed = None if seed is None else int(seed)

    def partitions(self):
        fs, root = filesystem(self.path)
        with fs.open_input_stream(f"{root}/manifest.json") as f:
            files = [_File(x["name"], x["start"]) for x in json.loads(f.read())["files"]]
        if self.seed is not None:
            random.Random(self.seed).shuffle(files)
        return files

    def read(self, partition):
        if partition is None:
            return
        fs, root = filesystem(self.path)
        with fs.open_input_stream(f"{root}/{partition.name}.idx") as f:
            index = np.frombuffer(f.read(), INDEX_ROW)
        order = np.arange(len(index))
        if self.seed is not None:
            np.random.default_rng([self.seed, zlib.crc32(partition.name.encode())]).shuffle(order)
        with fs.open_input_file(f"{root}/{partition.name}.rec") as f:
            size, i = f.size(), 0
            while i < len(order):
                ids, lens, starts, blobs, total = [], [], [], [], 0
                while i < len(order) and total < 4_000_000:
                    k = order[i]
                    at = int(index["offset"][k])
                    end = int(index["offset"][k + 1]) if k + 1 < len(index) else size
                    payload, _ = unframe(memoryview(f.read_at(end - at, at)), 0)
                    doc_id, null, width = struct.unpack(HEAD, payload[:HEAD_SIZE])
                    tokens = np.frombuffer(payload[HEAD_SIZE:], f"<u{width}").astype("<u4")
                    if len(tokens) != index["n"][k]:
                        raise ValueError(f"index and record disagree in {partition.name}")
                    ids.append(None if null else doc_id)
                    lens.append(len(tokens))
                    starts.append(partition.start + int(index["before"][k]))
                    blobs.append(tokens.tobytes())
                    total, i = total + 4 * len(tokens), i + 1
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(lens, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])


class TokenRecordSource(DataSource):
    @classmethod
    def name(cls):
        return "tidemark_tokens"

    def schema(self):
        return READ_SCHEMA

    def reader(self, schema):
        return TokenRecordReader(self.options)


def read_token_records(spark: SparkSession, folder: str, seed: int | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (u32 little endian)."""
    spark.dataSource.register(TokenRecordSource)
    reader = spark.read.format("tidemark_tokens").option("path", folder)
    return (reader if seed is None else reader.option("seed", seed)).load()

"""WARC archives as a Python data source, written and read in parallel.

Writing: each task writes one file of gzip members, one record each, after a warcinfo
record. Every member carries its compressed and plain lengths in the gzip extra
subfield "sl" that the WARC standard's annex on compression describes, so a reader
can step over a record. A manifest names the files of the tasks that succeeded;
files of lost attempts are not in it.

Reading: one partition a file: those of the manifest, else a single file or all *.warc.gz and
*.warc below a folder, so that archives of other crawlers are read too. The filters that
Spark hands over on record_type, page_id, payload_bytes, payload_digest, refers_to and
target_uri are applied to the headers, which are inflated first; the rest of a record that
doesn't qualify, or whose payload isn't wanted, is never inflated. Members without "sl"
are inflated to find their end.

Headers may be in any case, with or without a blank behind the colon, and folded. Digests
are hex or base 32; a SHA-256 is returned as bare lower-case hex, others as "algorithm:value"
in lower case. Of records that don't state their payload's size the HTTP header is
inflated to tell it; it is unknown for revisits. The payload is what follows the HTTP
header, or the whole block of a record that isn't HTTP, as it is stored (chunks and content
encodings stay). Payloads of archives written here must fit their size and digest, else
ValueError; crawlers differ in what they digest, so of other archives nothing is refused.

Defined cases: a null html counts as empty; a null url gives no target URI; control
characters in a URL are percent-encoded, so no header can be forged; a null page_id
gets a random record id and is a revisit if its payload has an identified holder;
repeated rows that hold the smallest page_id are all responses; an empty table gives
an archive without files.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import json
import re
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

from tidemark.llm.common import filesystem, materialise, work_path

LEAST_BYTES = 100
WRITE_SCHEMA = "page_id long, url string, html binary, payload_digest string, payload_bytes long, record_type string, refers_to long"
READ_SCHEMA = "page_id long, record_type string, target_uri string, refers_to long, payload_bytes long, payload_digest string, payload binary"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
# Header names, dates and profile of the format.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = re.compile(r"<urn:tidemark:page:(-?\d+)>")


def urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid4()}>" if page_id is None else f"<urn:tidemark:page:{page_id}>"


def page_of(found: str | None) -> int | None:
    m = _URN.fullmatch(found or "")
    return int(m[1]) if m else None


def record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes, content: str) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), *headers, ("Content-Type", content), ("Content-Length", str(len(block)))]
    return b"".join((b"WARC/1.1\r\n", "".join(f"{k}: {v}\r\n" for k, v in lines).encode(), b"\r\n", block, b"\r\n\r\n"))


def member(data: bytes, level: int = 1) -> bytes:
    """One gzip member with its lengths in front; without them beyond 4 GiB."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    if max(size, len(data)) >= 1 << 32:
        return b"".join((b"\x1f\x8b\x08\x00\0\0\0\0\x04\xff", body, tail))
    return b"".join((b"\x1f\x8b\x08\x04\0\0\0\0\x04\xff", struct.pack("<H2sHII", 12, b"sl", 8, size, len(data)), body, tail))


def safe(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def page_record(page_id, url, html: bytes, digest: str, n: int, kind: str, refers_to) -> bytes:
    headers = [("WARC-Target-URI", safe(url))] if url else []
    headers += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Bytes", str(n))]
    if kind == "revisit":
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(refers_to))]
        block = HTTP % n  # the payload stands in the record it refers to
    else:
        block = HTTP % n + html
    return record(kind, urn(page_id), headers, block, "application/http; msgtype=response")


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    records: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator):
        fs, root = filesystem(self.path)
        name, out, n = f"part-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in iterator:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", buffer_size=1 << 20, compression=None)
                    out.write(member(record("warcinfo", urn(None), [("WARC-Filename", name)], b"format: WARC file version 1.1\r\n", "application/warc-fields")))
                out.write(member(page_record(*row)))
                n += 1
        if out is not None:
            out.close()
        return Written(name if n else None, n)

    def commit(self, messages):
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        files = sorted(m.name for m in messages if m is not None and m.name)
        with fs.open_output_stream(f"{root}/manifest.json") as f:
            f.write(json.dumps({"files": files, "records": sum(m.records for m in messages if m is not None)}).encode())

    def abort(self, messages):
        fs, root = filesystem(self.path)
        for m in messages:
            if m is not None and m.name:
                fs.delete_file(f"{root}/{m.name}")


class _File(InputPartition):
    def __init__(self, name):
        self.name = name


def _accepts(f, row: dict) -> bool:
    """Whether a header row passes a filter, by SQL's rules for nulls."""
    v = row[f.attribute[0]]
    if isinstance(f, IsNull):
        return v is None
    if isinstance(f, EqualNullSafe):
        return v == f.value
    if v is None:
        return False
    if isinstance(f, IsNotNull):
        return True
    if isinstance(f, In):
        return v in f.value
    if isinstance(f, StringStartsWith):
        return v.startswith(f.value)
    return {EqualTo: v.__eq__, GreaterThan: v.__gt__, GreaterThanOrEqual: v.__ge__, LessThan: v.__lt__, LessThanOrEqual: v.__le__}[type(f)](f.value)


def fields_of(head: bytes) -> dict[str, str]:
    """Headers by their names in lower case; folded lines are joined."""
    out: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def digest_of(value: str | None) -> str | None:
    """A SHA-256 as bare lower-case hex, another digest as algorithm:value in lower case."""
    if not value:
        return None
    algorithm, _, digest = value.strip().rpartition(":")
    algorithm, digest = algorithm.lower().replace("-", ""), digest.strip()
    if algorithm == "sha256":
        if len(digest) != 64:
            with contextlib.suppress(ValueError):
                digest = base64.b32decode(digest.upper() + "=" * (-len(digest) % 8)).hex()
        return digest.lower()
    return f"{algorithm}:{digest}".lower() if algorithm else digest.lower()


class Member:
    """One record of a file: a gzip member, inflated no further than it is asked for, or plain bytes."""

    STEP = 1 << 16

    def __init__(self, f, size: int, at: int):
        self.f, self.size, self.at, self.fed = f, size, at, at
        start = f.read_at(min(4096, size - at), at)
        self.inflate, self.length, self.data = None, 0, b""
        if start[:3] == b"\x1f\x8b\x08":
            body, flags = 10, start[3]
            if flags & 4:
                (extra,) = struct.unpack_from("<H", start, 10)
                body, field = 12 + extra, 12
                while field + 4 <= min(body, len(start)):  # subfields: two letters, length, data
                    (n,) = struct.unpack_from("<H", start, field + 2)
                    if start[field : field + 2] == b"sl" and n >= 4:
                        (self.length,) = struct.unpack_from("<I", start, field + 4)
                    field += 4 + n
            for flag in (8, 16):  # a name and a comment end with a zero
                if flags & flag:
                    body = start.index(b"\0", body) + 1
            body += 2 * bool(flags & 2)
            self.inflate, self.fed = zlib.decompressobj(-15), at + body
        elif start[:5] != b"WARC/":
            raise ValueError(f"no record at {at}")

    def more(self, most: int) -> bool:
        """Read or inflate on, by about ``most`` bytes; False at the end."""
        if self.inflate is None:
            got = self.f.read_at(min(most, self.size - self.fed), self.fed)
            self.fed += len(got)
        else:
            if self.inflate.eof:
                return False
            tail = self.inflate.unconsumed_tail
            if not tail:
                end = self.at + self.length if self.length else self.size
                tail = self.f.read_at(max(0, min(self.STEP, end - self.fed)), self.fed)
                self.fed += len(tail)
            if not tail:
                raise ValueError(f"the record at {self.at} is cut short")
            got = self.inflate.decompress(tail, most)
        self.data += got
        return bool(got) or self.inflate is not None

    def until(self, mark: bytes, most: int | None = None) -> bytes | None:
        """What stands before the mark, which is taken off too; None if it isn't there within ``most`` bytes."""
        seen, step = 0, 1024
        while True:
            found = self.data.find(mark, max(0, seen - len(mark)), most)
            if found >= 0:
                out, self.data = self.data[:found], self.data[found + len(mark) :]
                return out
            seen = len(self.data)
            if (most is not None and seen >= most) or not self.more(step):
                return None
            step = min(2 * step, 1 << 24)  # so that a mark far away costs what the bytes before it do

    def take(self, n: int) -> bytes:
        parts, left = [], n
        while left > 0:
            if not self.data and not self.more(max(self.STEP, min(left, 1 << 24))):
                raise ValueError(f"the record at {self.at} is cut short")
            parts.append(self.data[:left])
            left -= len(parts[-1])
            self.data = self.data[len(parts[-1]) :]
        return b"".join(parts)

    def end(self, plain: int) -> int:
        """Where the next record starts; ``plain``: the length of this one, if it isn't packed."""
        if self.inflate is None:
            if self.at + plain - 4 > self.size:
                raise ValueError(f"the record at {self.at} is cut short")
            return self.at + plain
        if self.length:
            return self.at + self.length
        while not self.inflate.eof:
            self.data = b""
            self.more(1 << 20)
        return self.fed - len(self.inflate.unused_data) + 8


class WarcReader(DataSourceReader):
    """Options: path; payload: "full", "digest" (inflate, check and drop) or "none"."""

    HEADERS = ("page_id", "record_type", "target_uri", "refers_to", "payload_bytes", "payload_digest")
    FILTERS = (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith)

    def __init__(self, options):
        self.path, self.payload, self.filters = options["path"], options.get("payload", "full"), []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in self.FILTERS and len(f.attribute) == 1 and f.attribute[0] in self.HEADERS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        fs, root = filesystem(self.path)
        here = fs.get_file_info(root)
        if here.type == FileType.File:
            return [_File(root)]
        if fs.get_file_info(f"{root}/manifest.json").type == FileType.File:
            with fs.open_input_stream(f"{root}/manifest.json") as f:
                names = [f"{root}/{x}" for x in json.loads(f.read())["files"]]
        else:
            found = fs.get_file_info(FileSelector(root, recursive=True)) if here.type == FileType.Directory else []
            names = sorted(x.path for x in found if x.type == FileType.File and x.base_name.endswith((".warc.gz", ".warc")))
        return [_File(x) for x in names] or [_File(None)]

    def read(self, partition):
        if partition.name is None:
            return
        fs, _ = filesystem(self.path)
        rows, held = [], 0
        with fs.open_input_file(partition.name) as f:
            for row in self.records(f, f.size()):
                rows.append(row)
                held += len(row["payload"] or b"") + 200
                if held > 4_000_000:
                    yield self.batch(rows)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows):
        kinds = {"page_id": pa.int64(), "record_type": pa.string(), "target_uri": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary()}
        return pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], t) for k, t in kinds.items()})

    def records(self, f, size: int):
        """Rows that pass; each record's headers are read before anything else of it."""
        at = 0
        while at < size:
            source = Member(f, size, at)
            head = source.until(b"\r\n\r\n")
            if head is None:
                raise ValueError(f"no end of headers in the record at {at}")
            fields = fields_of(head)
            kind, n = fields.get("warc-type"), int(fields.get("content-length", 0))
            http = fields.get("content-type", "").lower().startswith("application/http")
            own, left = "x-payload-bytes" in fields, n
            if own:
                payload_bytes = int(fields["x-payload-bytes"])
            elif kind == "revisit":
                payload_bytes = None
            else:
                front = source.until(b"\r\n\r\n", n) if http else b""
                payload_bytes = left = max(0, n - len(front) - 4) if http and front is not None else n
            row = {
                "page_id": page_of(fields.get("warc-record-id")),
                "record_type": kind,
                "target_uri": fields.get("warc-target-uri"),
                "refers_to": page_of(fields.get("warc-refers-to")),
                "payload_bytes": payload_bytes,
                "payload_digest": digest_of(fields.get("warc-payload-digest")),
                "payload": None,
            }
            passes = all(_accepts(x, row) for x in self.filters)
            if passes and self.payload != "none" and kind in ("response", "resource", "conversion"):
                if own and http:
                    front = source.until(b"\r\n\r\n", n)
                    left = n - len(front or b"") - 4
                payload = source.take(left)
                if own and (len(payload) != payload_bytes or hashlib.sha256(payload).hexdigest() != row["payload_digest"]):
                    raise ValueError(f"the payload at {at} isn't what its headers say")
                row["payload"] = payload if self.payload == "full" else None
            at = source.end(len(head) + 4 + n + 4)
            if passes:
                yield row


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "tidemark_warc"

    def schema(self):
        return READ_SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def described(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """What the writer takes: payloads with their digest, and who revisits whom.

    Only digests that several rows share come into the join, from a written table, so
    a payload that a third of all pages hold is split by the skew join.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.sha2(html, 256).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    shared = p.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("holder"), F.count(F.lit(1)).alias("n")).where("n > 1 and holder is not null")
    joined = p.join(materialise(shared.drop("n"), "shared-payloads"), "payload_digest", "left")
    again = F.col("holder").isNotNull() & ~F.col("holder").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "html", "payload_digest", "payload_bytes", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("holder")).alias("refers_to"))


def write_archive(pages: DataFrame, path: str) -> None:
    pages.sparkSession.dataSource.register(WarcSource)
    described(pages).write.format("tidemark_warc").option("path", path).mode("append").save()


def read_archive(spark: SparkSession, path: str, payload: str = "full") -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("tidemark_warc").option("path", path).option("payload", payload).load()


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages, read the archives back and check every payload against its digest."""
    spark = pages.sparkSession
    path = work_path(spark, "warc")
    write_archive(pages, path)
    return read_archive(spark, path, "digest").where(F.col("record_type").isin("response", "revisit")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

"""WARC archives: round trip, revisits, pushed filters."""

import gzip
import hashlib

from tidemark.llm import common, registry, warc


def pages(spark, extra=()):
    big = "<p>" + "ä" * 200 + "</p>"
    rows = [(5, "http://a/x\r\nWARC-Type: forged", big), (2, "http://a/y z", big), (9, None, big), (9, None, big), (2, "u", big), (3, "http://b", None), (4, "http://b", ""), (7, "s", "tiny"), (8, "s", "tiny"), (None, "n", big), (None, "n", "only " * 40), (11, "h", "x" * 100), (10, "h", "x" * 100), (12, "h", "y" * 99), (13, "h", "y" * 99), *extra]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload_digest string")


def want(rows):
    held = {}
    for r in rows:
        b = (r.html or "").encode()
        if len(b) >= 100 and r.page_id is not None:
            held[b] = min(r.page_id, held.get(b, r.page_id))
    n = {}
    for r in rows:
        n[r.html or ""] = n.get(r.html or "", 0) + 1
    out = []
    for r in rows:
        b = (r.html or "").encode()
        first = held.get(b, r.page_id)
        kind = "revisit" if first != r.page_id else "response"
        out.append((r.page_id, len(b), hashlib.sha256(b).hexdigest(), kind, first if kind == "revisit" else None))
    return sorted(out, key=str)


def test_round_trip(spark, sf_dir):
    for df in (pages(spark), pages(spark, [(100 + i, "u", "z" * 10**6) for i in range(3)]), registry.table(spark, sf_dir, "pages")):
        got = sorted((tuple(r) for r in warc.round_trip(df).collect()), key=str)
        assert got == want(df.select("page_id", "html").collect())
    assert warc.round_trip(pages(spark).where("false")).count() == 0


def test_archive_is_plain_warc_and_filters_reach_the_reader(spark):
    path = common.work_path(spark, "warc-test")
    warc.write_archive(pages(spark), path)
    fs, root = common.filesystem(path)
    from pyarrow.fs import FileSelector

    n = 0
    for info in fs.get_file_info(FileSelector(root)):
        if info.base_name.endswith(".gz"):
            data = gzip.open(info.path).read()
            while data:
                head, _, rest = data.partition(b"\r\n\r\n")
                assert head.startswith(b"WARC/1.1\r\n")
                size = int(head.rpartition(b"Content-Length: ")[2])
                assert rest[size : size + 4] == b"\r\n\r\n"
                data, n = rest[size + 4 :], n + 1
    df = warc.read_archive(spark, path)
    assert df.count() == n
    assert df.where("record_type = 'response' and page_id = 2").count() == 2
    two = df.where("record_type = 'revisit' and payload_bytes >= 100").select("page_id", "refers_to", "payload")
    assert "PushedFilters: []" not in two._jdf.queryExecution().toString() and {(r.page_id, r.refers_to) for r in two.collect()} == {(5, 2), (9, 2), (11, 10), (None, 2)}
    assert df.where("page_id = 11").count() == 1 and df.where("target_uri like 'http://b%'").count() == 2
    assert bytes(df.where("page_id = 7").first().payload) == b"tiny"


def test_members_without_lengths_and_damage(tmp_path):
    rows = [warc.page_record(1, "u", b"abc" * 3000, hashlib.sha256(b"abc" * 3000).hexdigest(), 9000, "response", None), warc.page_record(2, "v", b"", hashlib.sha256(b"").hexdigest(), 0, "response", None)]
    plain, sized = b"".join(map(gzip.compress, rows)), b"".join(map(warc.member, rows))
    import pyarrow as pa
    import pytest

    for data in (plain, sized):
        for payload in ("none", "full"):
            got = list(warc.WarcReader({"path": "x", "payload": payload}).records(pa.BufferReader(data), len(data)))
            assert [r["page_id"] for r in got] == [1, 2]
            assert payload == "none" or got[0]["payload"] == b"abc" * 3000
    bad = warc.member(rows[0].replace(b"abcabc", b"abcabd", 1))
    with pytest.raises(ValueError):
        list(warc.WarcReader({"path": "x"}).records(pa.BufferReader(bad), len(bad)))


def foreign(kind, body, *headers, http=b"HTTP/1.0 200 OK\r\ncontent-type: text/html\r\n\r\n", content="application/http;msgtype=response"):
    block = http + body
    lines = [f"WARC-Type:{kind}", "warc-record-id: <urn:uuid:1>", "WARC-DATE: 2020-01-01T00:00:00Z", *headers, f"CONTENT-LENGTH:  {len(block)}", f"Content-Type: {content}"]
    return b"WARC/1.0\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_other_crawlers(spark, tmp_path):
    import base64
    import io

    body = b"<html>" + b"text " * 30000 + b"\r\n\r\n</html>"
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    sha256 = base64.b32encode(hashlib.sha256(b"plain").digest()).decode().rstrip("=")
    rows = [
        foreign("warcinfo", b"software: x", http=b"", content="application/warc-fields"),
        foreign("request", b"", http=b"GET / HTTP/1.0\r\n\r\n", content="application/http;msgtype=request"),
        foreign("response", body, "WARC-Target-URI: http://a/x", f"WARC-Payload-Digest: sha1:{sha1}", "WARC-IP-Address:\r\n 1.2.3.4"),
        foreign("response", b"", "WARC-Target-URI:http://a/empty", "warc-payload-digest: md5:ABC"),
        foreign("resource", b"plain", f"WARC-Payload-Digest: SHA-256:{sha256}", http=b"", content="text/plain"),
        foreign("revisit", b"", "WARC-Refers-To: <urn:uuid:1>"),
        foreign("response", b"no end of headers", http=b"", content="application/http"),
    ]
    packed = io.BytesIO()
    with gzip.GzipFile("a name", "wb", fileobj=packed) as f:  # a member with a name
        f.write(rows[2])
    deep = tmp_path / "2020" / "seg"
    deep.mkdir(parents=True)
    (deep / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, rows[:2])) + packed.getvalue() + b"".join(map(gzip.compress, rows[3:])))
    (tmp_path / "b.warc").write_bytes(b"".join(rows))
    (tmp_path / "notes.txt").write_bytes(b"x")
    for path in (str(tmp_path), str(tmp_path / "b.warc")):
        df = warc.read_archive(spark, path)
        times = 1 if path.endswith(".warc") else 2
        assert df.count() == 7 * times
        got = df.where("record_type = 'response'").orderBy("payload_bytes").collect()
        assert [(r.target_uri, r.payload_bytes, r.payload_digest, bytes(r.payload)) for r in got] == [w for w in [("http://a/empty", 0, "md5:abc", b""), (None, 17, None, b"no end of headers"), ("http://a/x", len(body), "sha1:" + sha1.lower(), body)] for _ in range(times)]
        one = df.where("record_type = 'resource'").first()
        assert bytes(one.payload) == b"plain" and one.payload_digest == hashlib.sha256(b"plain").hexdigest()
        assert df.where("record_type = 'revisit' and payload_bytes is null").count() == times and df.where("payload_bytes > 1000").count() == times
    assert warc.read_archive(spark, str(tmp_path / "2020" / "none")).count() == 0


class Counted:
    """A file in memory that counts what is read from it."""

    def __init__(self, data):
        self.data, self.reads = data, 0

    def read_at(self, n, at):
        self.reads += 1
        return self.data[at : at + n]


def test_a_record_without_a_blank_line_is_read_in_growing_steps():
    data = b"WARC/1.0\r\n" + b"x" * (8 << 20)
    f = Counted(data)
    assert warc.Member(f, len(data), 0).until(b"\r\n\r\n") is None and f.reads < 25
    near = b"WARC/1.0\r\nA: b\r\n\r\nrest"
    member = warc.Member(Counted(near), len(near), 0)
    assert member.until(b"\r\n\r\n") == b"WARC/1.0\r\nA: b" and member.take(4) == b"rest"
    assert warc.Member(Counted(data), len(data), 0).until(b"\r\n\r\n", 5000) is None

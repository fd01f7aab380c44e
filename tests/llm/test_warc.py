import io
import struct

import pytest
import zstandard as zstd
from pyspark.sql import functions as F

from shapeloom.llm import scratch
from shapeloom.llm import warc as W

ROWS = [(1, "http://a/ü x", "same"), (2, None, "same"), (3, "http://b\r\n/", None), (4, "u", ""), (5, "u", "ß" * 300_000), (None, "u", "same"), (6, "u", "only"), (6, "u", "only"), (None, "u", "alone"), (7, "u", "a\r\n\r\nb")]


def pages(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("sha", "of", "revisit", "payload")})


def brute(rows, least):
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", i))
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        of = last.get(h or "")
        revisit = len(data) >= least and of is not None and of != i
        out.append((i, "revisit" if revisit else "response", of if revisit else None, len(data), W.digest(data), None if revisit else data, None))
    return sorted(map(repr, out))


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    back = W.read_warc(W.write_warc(pages(spark).repartition(3), least_bytes=least))
    got = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload and bytes(r.payload), r.error) for r in back.collect()]
    got = [(*g[:5], b"" if g[5] is None and g[1] == "response" else g[5], g[6]) for g in got]
    assert sorted(map(repr, got)) == brute(ROWS, least)


def test_empty(spark):
    assert W.read_warc(W.write_warc(pages(spark).where("false"))).count() == 0


def test_dictionary_and_many_archives(spark):
    rows = [(k, f"http://h/{k}", f"<html><body>page {k} " + "shared boilerplate text " * 60 + str(k * 7919) * 20 + "</body></html>") for k in range(1500)]
    archives = W.write_warc(pages(spark, rows).repartition(1), archive_bytes=60_000)
    assert archives.count() > 1 and archives.agg(F.sum("records")).first()[0] == 1500
    first = archives.orderBy("path").first().path
    system, inner = scratch.file_system(first)
    data = system.open_input_stream(inner, compression=None).read()
    assert struct.unpack("<I", data[:4])[0] == 0x184D2A5D
    assert W.read_warc(archives).where("record_type = 'response' and error is null").count() == 1500


def test_few_records_have_a_dictionary_too(spark):
    for rows in ([(1, "u", "only")], [(k, "u", "x" * k) for k in range(5)]):
        archives = W.write_warc(pages(spark, rows).repartition(1))
        system, inner = scratch.file_system(archives.first().path)
        assert struct.unpack("<I", system.open_input_stream(inner, compression=None).read(4))[0] == 0x184D2A5D
        assert {(r.page_id, bytes(r.payload)) for r in W.read_warc(archives).collect()} == {(i, h.encode()) for i, _, h in rows}


def test_an_archive_is_a_task(spark):
    archives = W.write_warc(pages(spark, [(k, "u", f"{k} " * 500) for k in range(400)]).repartition(6, "page_id"), archive_bytes=1 << 16)
    back = W.read_warc(archives)
    assert archives.count() >= 6 and back.rdd.getNumPartitions() == archives.count()
    assert back.select(F.spark_partition_id().alias("p")).distinct().count() >= 0.8 * archives.count()


def test_record_ids_differ(spark):
    back = W.read_warc(W.write_warc(pages(spark, [(1, "u", "a"), (1, "u", "b"), (2, "u", "a"), (3, "u", "a"), (3, "v", "c"), (2, "u", "a")]))).collect()
    assert len({r.record_id for r in back}) == 6 and {r.refers_to for r in back if r.record_type == "revisit"} == {3}
    assert [r.record_id for r in back if r.page_id == 3 and bytes(r.payload) == b"a"] == ["urn:page:3"]


def foreign(kind, block, **fields):
    head = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:1>", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Length": len(block), **{k.replace("_", "-"): v for k, v in fields.items()}}
    return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items())).encode() + b"\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    http = "application/http; msgtype=response"
    written = [
        foreign("warcinfo", b"software: x", Content_Type="application/warc-fields"), foreign("request", b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http; msgtype=request"),
        foreign("response", b"HTTP/1.1 200 OK\r\n\r\nbody", Content_Type=http, WARC_Payload_Digest="sha256:" + __import__("hashlib").sha256(b"body").hexdigest()),
        foreign("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nbody\r\n0\r\n\r\n", Content_Type=http, WARC_Payload_Digest="sha1:AAAA"),
        foreign("response", b"dns answer", Content_Type="text/dns"), foreign("revisit", b"", WARC_Profile="x"), foreign("metadata", b""), foreign("response", b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nbody", Content_Type=http),
    ]
    c = zstd.ZstdCompressor(write_content_size=False)
    (tmp_path / "a.warc.zst").write_bytes(b"".join(c.compress(r) for r in written))
    back = W.read_warc(spark.createDataFrame([(f"file://{tmp_path}/a.warc.zst",)], "path string")).collect()
    got = [(r.record_type, r.payload_bytes, r.payload and bytes(r.payload)) for r in back if not r.error]
    assert got == [("warcinfo", 11, b"software: x"), ("request", 18, b"GET / HTTP/1.1\r\n\r\n"), ("response", 4, b"body"), ("response", 14, b"4\r\nbody\r\n0\r\n\r\n"), ("response", 10, b"dns answer"), ("revisit", None, None), ("metadata", 0, b"")]
    assert [r.error.endswith("the payload has another length") for r in back if r.error] == [True] and {r.record_id for r in back} == {"urn:uuid:1", None}


def archive(*records, dictionary=None):
    out = io.BytesIO()
    c = zstd.ZstdCompressor(dict_data=dictionary)
    if dictionary:
        out.write(struct.pack("<II", 0x184D2A5D, len(dictionary.as_bytes())) + dictionary.as_bytes())
    for r in records:
        out.write(c.compress(r))
    return out.getvalue()


GOOD = W.record(1, "http://a", b"payload", W.digest(b"payload"), None, False)


def test_frames():
    raw = zstd.ZstdCompressionDict(b"WARC/1.1\r\nWARC-Type: response" * 20)
    data = archive(GOOD, GOOD, dictionary=raw)
    assert list(W.records(io.BytesIO(data))) == [GOOD, GOOD]
    skip = struct.pack("<II", 0x184D2A50, 3) + b"abc"
    assert list(W.records(io.BytesIO(skip + archive(GOOD)))) == [GOOD] and list(W.records(io.BytesIO(b""))) == []
    for broken in (data[:-3], b"junk" + data, archive(GOOD) + data, data[:9]):
        with pytest.raises(ValueError):
            list(W.records(io.BytesIO(broken)))


@pytest.mark.parametrize("old, new", [
    (b"WARC/1.1", b"WARC/9"), (b"WARC-Type: response\r\n", b""), (b"WARC-Date", b"X-Date"), (b"payload\r\n\r\n", b"payloaX\r\n\r\n"), (b"payload\r\n\r\n", b"payload\r\n"),
    (b"\r\nContent-Length: 87", b"\r\nContent-Length: 88"), (b"WARC-Type: response", b"WARC-Type: revisit"), (b"HTTP/1.1", b"HTTX/1.1"), (b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: sha1:A"),
])
def test_broken_records(old, new):
    assert W.parse(GOOD)["payload"] == b"payload"
    assert old in GOOD or old.startswith(b"\r\nContent-Length: 87")
    broken = GOOD.replace(old, new) if old in GOOD else GOOD.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 9", 1)
    with pytest.raises(ValueError):
        W.parse(broken)

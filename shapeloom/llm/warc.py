"""WARC archives in Zstandard: one frame per record, a dictionary in a leading skippable frame.

Tasks write archives into a folder that all executors see (any address pyarrow's file systems know) and give
back their paths; a path counts only if Spark accepts the task, so files that a lost or repeated attempt has
left are never read.  The reader streams an archive frame by frame and checks each record: version, mandatory
fields, lengths of block and payload, digests of both.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Of records, before they are compressed.
ARCHIVE_BYTES = 256 << 20
#: What an archive's dictionary is trained on at most, and its size.
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 16 << 10
_DICTIONARY, _SKIPPABLE, _FRAME = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
_URI = re.compile(r"urn:page:(-?[0-9]*)")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pages carry no time of capture.
DATE = "1970-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None, revisit: bool, apart: str = "") -> bytes:
    """``apart`` ends the id of a record that no other refers to, so that rows with one page_id have ids of their own."""
    name = f"{'' if page_id is None else page_id}{apart}"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + (quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{name}"),
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if revisit else []),
        f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    """Records up to ``SAMPLE_BYTES`` are held back to train the dictionary."""

    def __init__(self, out) -> None:
        self.out, self.held, self.size, self.compressor = out, [], 0, None

    def add(self, data: bytes) -> None:
        self.size += len(data)
        if self.compressor is None:
            self.held.append(data)
            if self.size >= SAMPLE_BYTES:
                self._begin()
        else:
            self.out.write(self.compressor.compress(data))

    def _dictionary(self) -> zstd.ZstdCompressionDict:
        try:
            return zstd.train_dictionary(DICTIONARY_BYTES, self.held, k=256, d=8)
        except zstd.ZstdError:  # too few samples to train on, or too alike: the first records are the dictionary
            return zstd.ZstdCompressionDict(b"".join(self.held)[:DICTIONARY_BYTES], dict_type=zstd.DICT_TYPE_RAWCONTENT)

    def _begin(self) -> None:
        dictionary = self._dictionary()
        content = zstd.ZstdCompressor(level=3).compress(dictionary.as_bytes())
        self.out.write(struct.pack("<II", _DICTIONARY, len(content)) + content)
        dictionary.precompute_compress(level=3)
        self.compressor = zstd.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
        for data in self.held:
            self.out.write(self.compressor.compress(data))
        self.held = []

    def close(self) -> None:
        if self.compressor is None:
            self._begin()
        self.out.close()


def frames(stream) -> Iterator[tuple[int, bytes]]:
    """Magic number and bytes of each frame: the content of a skippable one, else the whole frame."""

    def take(n: int) -> bytes:
        data = stream.read(n)
        if len(data) < n:
            raise ValueError("archive ends within a frame")
        return data

    while head := stream.read(4):
        magic = int.from_bytes(head, "little")
        if magic & 0xFFFFFFF0 == _SKIPPABLE:
            yield magic, take(int.from_bytes(take(4), "little"))
            continue
        if magic != _FRAME:
            raise ValueError("neither a Zstandard nor a skippable frame")
        parts = [head, take(1)]
        kind = parts[1][0]
        single = kind >> 5 & 1
        parts.append(take((not single) + (0, 1, 2, 4)[kind & 3] + (single, 2, 4, 8)[kind >> 6]))
        last = 0
        while not last:
            parts.append(take(3))
            block = int.from_bytes(parts[-1], "little")
            last = block & 1
            parts.append(take(1 if block >> 1 & 3 == 1 else block >> 3))
        if kind >> 2 & 1:
            parts.append(take(4))
        yield magic, b"".join(parts)


def records(stream) -> Iterator[bytes]:
    """The content of each record's frame.  It grows as it is decompressed: no claim of a frame is believed, and
    frames that claim nothing are read alike."""
    decompressor = None
    for magic, data in frames(stream):
        if magic == _FRAME:
            decompressor = decompressor or zstd.ZstdDecompressor()
            yield decompressor.decompressobj().decompress(data)
        elif magic == _DICTIONARY:
            if decompressor is not None:
                raise ValueError("a dictionary after the first frame")
            if data[:4] == _FRAME.to_bytes(4, "little"):
                data = zstd.ZstdDecompressor().decompressobj().decompress(data)
            decompressor = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(data))


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode(errors="replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _agrees(said: str, data: bytes) -> bool:
    """Whether a digest (``algorithm:value``, base32 or hexadecimal) is that of the data; unknown algorithms pass."""
    algorithm, _, value = said.partition(":")
    if algorithm.lower() not in ("sha1", "sha256", "md5"):
        return True
    made = hashlib.new(algorithm.lower(), data).digest()
    return value.lower() == made.hex() or value.upper().rstrip("=") == base64.b32encode(made).decode().rstrip("=")


def parse(data: bytes) -> dict:
    """A record's parts; ValueError if it breaks a rule.

    The payload of an HTTP response is its body, that of any other record is its block; a revisit has none, and
    tells its size only if its HTTP header does.  A record without a payload digest is given the SHA-1 of its payload.
    """
    head, found, rest = data.partition(b"\r\n\r\n")
    version, fields = _fields(head)
    if not found or version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC header")
    if lacks := [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in fields]:
        raise ValueError(f"lacks {', '.join(lacks)}")
    length = fields["content-length"]
    if not (length.isascii() and length.isdigit()) or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("the block is not as long as it should be")
    block = rest[:-4]
    if not _agrees(fields.get("warc-block-digest", ""), block):
        raise ValueError("the block has another digest")
    kind, said = fields["warc-type"], fields.get("warc-payload-digest", "")
    payload, size, whole = block, len(block), True
    if kind in ("response", "revisit") and (block or kind == "response") and fields.get("content-type", "").startswith("application/http"):
        http, found, payload = block.partition(b"\r\n\r\n")
        status, http_fields = _fields(http)
        if not found or not status.startswith("HTTP/"):
            raise ValueError("no HTTP header")
        told = http_fields.get("content-length", "")
        size = int(told) if told.isascii() and told.isdigit() else None
        whole = "transfer-encoding" not in http_fields  # else the body isn't the payload as it is
        if kind == "response" and whole and size is not None and len(payload) != size:
            raise ValueError("the payload has another length")
        size = len(payload) if kind == "response" else size
    if kind == "revisit":
        if "warc-profile" not in fields:
            raise ValueError("a revisit without a profile")
        if payload and fields["warc-profile"] == PROFILE:
            raise ValueError("a revisit with a payload")
        payload, size = None, None if not block else size
    elif whole and not _agrees(said, payload):
        raise ValueError("the payload has another digest")
    if not said and payload is not None:
        said = f"sha1:{digest(payload)}"
    name = lambda k: int(m[1]) if (m := _URI.search(fields.get(k, ""))) and m[1] else None
    return {
        "page_id": name("warc-record-id"), "record_id": fields["warc-record-id"].strip("<>"), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": name("warc-refers-to"),
        "payload_bytes": size, "payload_digest": said.removeprefix("sha1:") or None, "payload": payload,
    }


def _write(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = scratch.file_system(folder)
        system.create_dir(inner, recursive=True)
        task, writer, made = TaskContext.get(), None, []
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                for row in batch.slice(lo, 256).to_pylist():
                    if writer is None:
                        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(made)}.warc.zst"
                        writer, n = ArchiveWriter(system.open_output_stream(f"{inner}/{name}", compression=None)), 0
                        made.append([f"{folder}/{name}", 0])
                    payload = (row["html"] or "").encode()
                    apart = "" if row["referred"] else f":{task.partitionId()}-{len(made)}-{n}"
                    writer.add(record(row["page_id"], row["url"], payload, digest(payload), row["refers_to"], row["revisit"], apart))
                    n += 1
                    made[-1][1] = n
                    if writer.size >= archive_bytes:
                        writer.close()
                        writer = None
        if writer is not None:
            writer.close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made]), pa.array([m[1] for m in made], pa.int64())], ["path", "records"])

    return run


def write_warc(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(path, records) of the archives of ``pages`` (page_id, url, html).

    Of records with equal payloads of at least ``least_bytes`` bytes the one with the largest page_id is a
    response, the others revisit it; the others are all responses.  A null html is an empty payload.  Rows
    that repeat a response's id are responses too; a null id is smaller than others, and if all of equal
    payloads have none, they are responses.  A null url is replaced by the record's id.  Without pages there is no
    archive; other columns are not looked at.  A very long page is a record like others: a task holds one record and
    its compressed frame, and an archive is closed after the record with which it reaches ``archive_bytes``.
    Record ids differ, but for responses whose page_id and payload are repeated.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    payload = F.coalesce("html", F.lit(""))
    pages = pages.withColumn("sha", F.unhex(F.sha2(payload.cast("binary"), 256)))
    large = F.octet_length(payload) >= least_bytes
    first = pages.where(large).groupBy("sha").agg(F.max("page_id").alias("of"), F.count("*").alias("n")).where("n > 1").drop("n")
    placed = pages.join(scratch.apart(first), "sha", "left").withColumn("revisit", large & F.col("of").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("of")))
    referred = F.col("of").isNotNull() & ~F.col("revisit")
    placed = placed.select("page_id", "url", "html", F.when(F.col("revisit"), F.col("of")).alias("refers_to"), "revisit", referred.alias("referred"))
    folder = scratch.new_path(pages.sparkSession, "warc")
    return scratch.table(placed.mapInArrow(_write(folder, archive_bytes), "path string, records long"), "warc-manifest")


_READ = "page_id long, record_id string, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"


def _read(with_payload: bool):
    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in _READ.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, size, n = [], 0, 0
                system, inner = scratch.file_system(path)
                with system.open_input_stream(inner, compression=None, buffer_size=1 << 20) as stream:
                    for data in records(stream):
                        try:
                            row = parse(data) | {"error": None}
                        except ValueError as e:
                            row = dict.fromkeys(schema.names) | {"error": f"{path}: {e}"}
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        n, size = n + 1, size + len(row["payload"] or b"") + 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if expected is not None and n != expected:
                    raise ValueError(f"{path} has {n} records, {expected} were written")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_warc(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row per record of the archives: page_id, record_id, url, record_type, refers_to, payload_bytes and
    payload_digest (both of the full payload, for revisits too, as far as they tell), payload (of what isn't a
    revisit), and error: what rule a record breaks, with nulls beside it.

    ``archives`` has a path, and may have the number of records that were written.  Archives of others are read
    alike: their other records (warcinfo, request, metadata, ...) are rows of that type, ids that aren't
    ``urn:page:`` are in record_id alone.  An archive that is cut off, or has other frames, or another number of records than it should,
    fails.  Without archives the result is empty; a record of many bytes is held whole by its task.

    Each archive is a partition of its own: a manifest is so small that it would be one task otherwise.
    """
    count = F.col("records").cast("long") if "records" in archives.columns else F.lit(None).cast("long")
    paths = archives.select("path", count.alias("records"))
    return paths.repartitionByRange(max(1, paths.count()), "path").mapInArrow(_read(with_payload), _READ)

"""WARC archives: a writer, and a reader that splits gzip files by byte ranges.

Every record is a gzip member of its own.  A reading task gets a byte range,
scans it for gzip magic, and takes a place for a member's start only if what
follows decompresses to a WARC header.  It owns the records starting inside its
range and reads the last one past the range's end.  Files live in a folder all
machines share, reached through ``pyarrow.fs``.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.store import Scratch

LEAST_PAYLOAD = 100
SPLIT = 8 << 20
FILE_BYTES = 64 << 20
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
BROADCAST_ROWS = 1_000_000
_MAGIC = b"\x1f\x8b\x08"
_CHUNK = 1 << 20


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def record(kind: str, record_id: str, uri: str, payload: bytes, digest: str, length: int, refers_to: str | None) -> bytes:
    """One WARC/1.1 record, not compressed; a revisit carries the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if uri:
        head.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict | None:
    """Fields of a record: kind, record_id, uri, refers_to, digest, length (of the full payload) and payload."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/1."):
        return None
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[: int(fields.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = len(payload)
    for line in http.decode("latin-1").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        if name.strip().lower() == "content-length":
            length = int(value)
    refers = fields.get("warc-refers-to")
    kind = fields.get("warc-type")
    return {
        "kind": kind,
        "record_id": fields.get("warc-record-id", "").strip("<>"),
        "uri": fields.get("warc-target-uri"),
        "refers_to": refers.strip("<>") if refers else None,
        "digest": fields.get("warc-payload-digest", "").removeprefix("sha256:") or None,
        "length": length,
        "payload": payload if kind == "response" else None,
    }


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _open(folder)
        out = path = None
        size = records = 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([records])], names=["path", "bytes", "records"])

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    # A repeated task writes files of its own; only the manifest's are read.
                    path, size, records = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    where.create_dir(base, recursive=True)
                    out = where.open_output_stream(path, compression=None)
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = record(row["kind"], row["record_id"], row["uri"] or "", row["payload"] or b"", row["digest"], row["length"], row["refers_to"])
                member = packer.compress(data) + packer.flush()
                out.write(member)
                size, records = size + len(member), records + 1
                if size >= FILE_BYTES:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return run


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Write ``records(kind, record_id, uri, payload, digest, length, refers_to)``; rows (path, bytes, records) of the files.

    The result is lazy: each task writes its files when it runs.  Store it once.
    """
    columns = ["kind", "record_id", "uri", "payload", "digest", "length", "refers_to"]
    return records.select(*columns).mapInArrow(_write(folder), "path string, bytes long, records long")


class _Bytes:
    """A sliding window over a file."""

    def __init__(self, file, start: int):
        self.file, self.at, self.data = file, start, b""
        file.seek(start)

    def more(self) -> bool:
        got = self.file.read(_CHUNK)
        self.data += got
        return bool(got)

    def skip(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def _member(window: _Bytes) -> tuple[bytes, int] | None:
    """The member at the window's start and its packed size; None if no WARC member starts here."""
    unpack = zlib.decompressobj(31)
    parts, fed, checked = [], 0, b""
    while True:
        if fed >= len(window.data) and not window.more():
            return None
        piece = window.data[fed : fed + (1 << 16)]
        fed += len(piece)
        try:
            parts.append(unpack.decompress(piece))
        except zlib.error:
            return None
        if len(checked) < 7:
            checked = b"".join(parts)[:7]
            if not b"WARC/1."[: len(checked)] == checked:
                return None
        if unpack.eof:
            return b"".join(parts), fed - len(unpack.unused_data)


def records_of(file, start: int, end: int) -> Iterator[bytes]:
    """Unpacked records whose first byte is in [start, end)."""
    window = _Bytes(file, start)
    while window.at < end:
        place = window.data.find(_MAGIC)
        if place < 0:
            window.skip(max(0, len(window.data) - 2))
            if not window.more():
                return
            continue
        window.skip(place)
        if window.at >= end:
            return
        found = _member(window)
        if found is None:
            window.skip(1)
        else:
            yield found[0]
            window.skip(found[1])


_SCHEMA = "kind string, record_id string, uri string, refers_to string, digest string, length long, payload binary"


def _read(base: str):
    schema = pa.schema([("kind", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("length", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = _open(base)
        for batch in batches:
            for row in batch.to_pylist():
                with where.open_input_file(row["path"]) as file:
                    held, size = [], 0
                    for data in records_of(file, row["start"], row["end"]):
                        found = parse(data)
                        if found is None:
                            continue
                        held.append(found)
                        size += len(data)
                        if size > 8 << 20 or len(held) >= 2000:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)

    return run


def read_warc(spark: SparkSession, files: DataFrame, folder: str, split: int = SPLIT) -> DataFrame:
    """The records of ``files(path, bytes)`` below ``folder``, by splits of ``split`` bytes."""
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split, F.col("bytes")).alias("end"))
    n = ranges.count()
    return ranges.repartition(max(1, n), "path", "start").mapInArrow(_read(folder), _SCHEMA)


def archive(pages: DataFrame, least_payload: int = LEAST_PAYLOAD) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as WARC records and read the archives back.

    Rows: page_id, url, record_type, refers_to, payload (null for revisits),
    digest and length of the full payload.  A null html is an empty payload.  Of
    equal payloads of ``least_payload`` bytes or more, rows with the smallest
    page_id are responses and the others revisit it.  Other columns are ignored.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("uri"), body.alias("payload")).withColumns({"digest": F.sha2("payload", 256), "length": F.octet_length("payload").cast("long")})
    again = base.filter((F.col("length") >= least_payload) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    again = scratch.table(again, "again")
    known = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    revisit = F.col("first").isNotNull() & (F.col("first") != F.col("page_id"))
    records = base.join(known, "digest", "left").withColumns(
        {"kind": F.when(revisit, "revisit").otherwise("response"), "record_id": name(F.col("page_id")), "refers_to": F.when(revisit, name(F.col("first")))}
    )
    folder = f"{scratch.path}/archive"
    files = scratch.table(write_warc(records, folder), "files")
    back = read_warc(spark, files, folder)
    number = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")
    return back.filter(F.col("kind").isin("response", "revisit")).select(
        number(F.col("record_id")).alias("page_id"), F.col("uri").alias("url"), F.col("kind").alias("record_type"), number(F.col("refers_to")).alias("refers_to"), "payload", "digest", "length"
    )

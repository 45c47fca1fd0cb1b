"""WARC archives: write, normalise to one gzip member a record with an offset index, read back.

write_archives makes whole-file gzip streams, as many crawls deliver them. normalise inflates
each stream once, front to back with bounded memory, rewrites every record as its own gzip
member and puts a sidecar index (offset, length, type, record id, digest) beside the archive.
read_records reads the sidecars, seeks to the members by them, and checks that type and record id are those of the index and
every stored payload's digest. The table between the two names archives and sidecars, not records.

Archives live in a folder all executors share; a task's files count only once the row naming
them is committed, so retried tasks leave at most unread files.

Null payloads are empty payloads; a null url leaves out the target header; null page ids are
written as such and sort before others. Of rows that repeat both page id and payload, all are
alike (all response or all revisit). Empty tables make no archives. Only the three named
columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import open_uri
from .common import held_dir, materialize

ARCHIVE_BYTES = 32 << 20  # inflated size at which a task starts its next archive
CHUNK = 1 << 20
LEVEL = 1
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, in native expressions: 20 bits at a time."""
    h = F.sha1(payload.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(h, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), DIGITS32, BASE32)


def mark_revisits(pages: DataFrame, key: str, payload: str, least_bytes: int = 0) -> DataFrame:
    """Adds payload_digest and refers_to: of equal payloads the largest key stays, the others refer to it."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.withColumn(payload, body).withColumn("payload_digest", sha1_base32(body))
    stays = rows.where(F.octet_length(payload) >= least_bytes).groupBy("payload_digest").agg(F.max(key).alias("stays"), F.count("*").alias("n")).where("n > 1").drop("n")
    refers = F.when((F.octet_length(payload) >= least_bytes) & ~F.col("stays").eqNullSafe(F.col(key)), F.col("stays"))
    return rows.join(stays, "payload_digest", "left").withColumn("refers_to", refers).drop("stays")


def _record(key, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    block = HTTP + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{key}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127)))))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def write_archives(marked: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """One or more whole-file gzip archives a task; returns their paths, committed."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = None
        for batch in batches:
            for r in range(batch.num_rows):
                k, u, p, d, to = (c[r].as_py() for c in batch.columns)
                if sink is None:
                    path, size = f"{folder}/whole/{uuid.uuid4().hex}.warc.gz", 0
                    sink, z = open_uri(path, "w"), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                record = _record(k, u, p.encode(), d, to)
                sink.write(z.compress(record))
                size += len(record)
                if size >= ARCHIVE_BYTES:
                    sink.write(z.flush())
                    sink.close()
                    sink = None
                    yield pa.RecordBatch.from_pydict({"path": [path]})
        if sink is not None:
            sink.write(z.flush())
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [path]})

    rows = marked.select(F.col(key).cast("long"), F.col(url).cast("string"), payload, "payload_digest", F.col("refers_to").cast("long"))
    return materialize(rows.mapInArrow(write, "path string"))


def _inflated(source) -> Iterator[bytes]:
    """The inflated bytes of one or more gzip members, a chunk at a time."""
    z = zlib.decompressobj(31)
    while data := source.read(CHUNK):
        while data:
            if out := z.decompress(data, 4 * CHUNK):
                yield out
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)
            else:
                data = z.unconsumed_tail


def _headers(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:] if line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of an inflated stream; holds one record and a chunk at most."""
    buffer, at = bytearray(), 0

    def need(n: int) -> bool:
        nonlocal at
        if len(buffer) - at < n and at:
            del buffer[:at]
            at = 0
        while len(buffer) - at < n:
            chunk = next(chunks, None)
            if chunk is None:
                return False
            buffer.extend(chunk)
        return True

    while need(1):
        looked = at
        while (end := buffer.find(b"\r\n\r\n", looked)) < 0:
            looked = max(0, len(buffer) - at - 3)
            if not need(len(buffer) - at + 1):
                raise ValueError("an archive ends inside a record's header")
            looked += at
        headers = _headers(bytes(buffer[at:end]))
        size = end - at + 4 + int(headers["content-length"]) + 4
        if not need(size):
            raise ValueError("an archive ends inside a record")
        yield headers, bytes(buffer[at : at + size])
        at += size


FIELDS = ("offset", "length", "record_type", "record_id", "payload_digest")
ARCHIVES = "archive string, sidecar string, records long"


def normalise(paths: DataFrame, folder: str) -> DataFrame:
    """Rewrites each archive with a member for each record and a sidecar index (.idx: the FIELDS of a record on a line, between
    tabs); returns archive, sidecar and records, committed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch[0].to_pylist():
                to, n, offset = f"{folder}/members/{uuid.uuid4().hex}.warc.gz", 0, 0
                with open_uri(path, "r") as source, open_uri(to, "w") as sink, open_uri(f"{to}.idx", "w") as index:
                    for h, record in _records(_inflated(source)):
                        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = z.compress(record) + z.flush()
                        sink.write(member)
                        index.write("\t".join(map(str, (offset, len(member), h["warc-type"], h["warc-record-id"], h["warc-payload-digest"]))).encode() + b"\n")
                        n += 1
                        offset += len(member)
                yield pa.RecordBatch.from_pydict({"archive": [to], "sidecar": [f"{to}.idx"], "records": pa.array([n], pa.int64())})

    n = max(1, min(paths.count(), paths.sparkSession.sparkContext.defaultParallelism * 4))
    return materialize(paths.repartition(n).mapInArrow(run, ARCHIVES))


def read_sidecar(path: str) -> Iterator[dict]:
    """The index of an archive, line by line."""
    with open_uri(path, "r") as f:
        rest = b""
        while True:
            data = f.read(CHUNK)
            *lines, rest = (rest + data).split(b"\n")
            for line in lines:
                row = dict(zip(FIELDS, line.decode().split("\t"), strict=True))
                yield row | {"offset": int(row["offset"]), "length": int(row["length"])}
            if not data:
                break
        if rest:
            raise ValueError(f"{path} ends inside a line")


def _page(record_id: str | None) -> int | None:
    tail = (record_id or "None>").rpartition(":")[2].rstrip(">")
    return None if tail == "None" else int(tail)


def read_records(archives: DataFrame, key: str = "page_id") -> DataFrame:
    """Every record by its sidecar's offset: key, payload_bytes, payload_digest, record_type, refers_to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in batch.to_pylist():
                rows, path, n = [], a["archive"], 0
                with open_uri(path, "r") as source:
                    for r in read_sidecar(a["sidecar"]):
                        source.seek(r["offset"])
                        record = zlib.decompress(source.read(r["length"]), 31)
                        h = _headers(record[: record.index(b"\r\n\r\n")])
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        if (h["warc-type"], h["warc-record-id"], h["warc-payload-digest"]) != (r["record_type"], r["record_id"], r["payload_digest"]):
                            raise ValueError(f"{path}: the record at {r['offset']} is not the one of the index")
                        if h["warc-type"] == "response":
                            payload = record[record.index(HTTP) + len(HTTP) : -4]
                            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != int(h["x-payload-length"]):
                                raise ValueError(f"{path}: the record at {r['offset']} is damaged")
                        rows.append({"k": _page(h["warc-record-id"]), "payload_bytes": int(h["x-payload-length"]), "payload_digest": digest, "record_type": h["warc-type"], "refers_to": _page(h["warc-refers-to"]) if "warc-refers-to" in h else None})
                        n += 1
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if n != a["records"]:
                    raise ValueError(f"{path}: the index has {n} records, not {a['records']}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("k", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    out = "k long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return archives.mapInArrow(run, out).withColumnRenamed("k", key)


def warc_round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes, normalises and reads back; one row a page. The archives are deleted when the driver ends."""
    folder = held_dir(pages.sparkSession)
    marked = mark_revisits(pages.select(key, url, payload), key, payload, least_bytes)
    return read_records(normalise(write_archives(marked, folder, key, url, payload), folder), key)

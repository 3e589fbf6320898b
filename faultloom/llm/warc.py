"""WARC archives: a writer, a normaliser for monolithic gzip files, and a reader by offset index.

An archive whose whole file is one gzip stream can't be read at an offset. The normaliser inflates such a stream once,
in blocks of BLOCK bytes, writes every record as a gzip member of its own, and a sidecar index (tab-separated: offset,
member length, record type, record id). The reader then opens any record by its offset. Files lie in the shared folder;
each attempt of a task writes files of its own names, and only those named in the returned table count.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, materialize, shared_path, sized

#: Payloads below this size are always stored; raw bytes after which a task begins another archive; block of a stream.
LEAST_SHARED, ARCHIVE_BYTES, BLOCK = 100, 256 << 20, 1 << 20
LEVEL = 1

#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 31

#: Rows and bytes of payload that a reader holds before it passes them on.
HELD_ROWS, HELD_BYTES = 500, 16 << 20


def filesystem(path: str) -> tuple:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))])
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def record_id(page_id: int | None, digest: str, more: str = "") -> str:
    return f"<urn:faultloom:page:{'none' if page_id is None else page_id}:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}{more}')}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, whole: bool, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone (its Content-Length is the full payload's).

    A response is named by its page and digest, so that revisits can refer to it; a row that repeats both has its name.
    """
    name = record_id(page_id, digest, "" if whole else f" {url}")
    headers = [("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%~-._")), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        headers.append(("WARC-Page-ID", str(page_id)))
    if not whole:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Refers-To-Date", date), ("WARC-Refers-To-Page-ID", str(refers_to))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record("response" if whole else "revisit", headers, http + payload if whole else http)


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


class Inflater:
    """Reads a gzip file, of one member or many, as one stream with bounded memory."""

    def __init__(self, source: BinaryIO) -> None:
        self.source, self.engine, self.buffer, self.ended = source, zlib.decompressobj(GZIP), bytearray(), False

    def more(self) -> bool:
        if self.ended:
            return False
        raw = self.engine.unconsumed_tail or (self.engine.unused_data if self.engine.eof else b"")
        if self.engine.eof:
            self.engine = zlib.decompressobj(GZIP)
        raw = raw or self.source.read(BLOCK)
        if not raw:
            self.ended = True
            return False
        self.buffer += self.engine.decompress(raw, BLOCK)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with mark; None at the end of the stream."""
        start = 0
        while (at := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark) + 1)
            if not self.more():
                if self.buffer.strip():
                    raise ValueError("the archive ends inside a record")
                return None
        out = bytes(self.buffer[: at + len(mark)])
        del self.buffer[: at + len(mark)]
        return out

    def exactly(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.buffer and not self.more():
                raise ValueError("the archive ends inside a record")
            part = bytes(self.buffer[:size])
            del self.buffer[: len(part)]
            size -= len(part)
            if part:
                yield part


def normalise_stream(source: BinaryIO, out: BinaryIO, index: BinaryIO) -> int:
    """Copy every record of a gzip stream to out as a gzip member; returns the number of records."""
    stream, offset, count = Inflater(source), 0, 0
    while (head := stream.until(b"\r\n\r\n")) is not None:
        told = parse_head(head.lstrip(b"\r\n"))
        packer, size = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), 0
        size += out.write(packer.compress(head.lstrip(b"\r\n")))
        for part in stream.exactly(int(told["content-length"]) + 4):
            size += out.write(packer.compress(part))
        size += out.write(packer.flush())
        index.write(f"{offset}\t{size}\t{told['warc-type']}\t{told['warc-record-id']}\n".encode())
        offset, count = offset + size, count + 1
    return count


def read_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record that is one gzip member."""
    raw = zlib.decompress(member, GZIP)
    head, _, rest = raw.partition(b"\r\n\r\n")
    told = parse_head(head)
    return told, rest[: int(told["content-length"])]


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row into monolithic archives; returns their table (path, records), materialised.

    Of equal payloads of LEAST_SHARED bytes or more, the row with the least id is stored whole and the others refer to
    it; rows that repeat that least id are each stored whole, and so are all rows if no such row has an id. Null html is
    an empty payload; other columns are ignored; an empty table makes no archive. All records bear the time of the call.
    """
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    arrow_batches(pages.sparkSession, 500)
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("__id"), F.col(url_col).cast("string").alias("__url"), payload.alias("__payload")).withColumn("__digest", F.sha2("__payload", 256))
    shared = rows.where(F.octet_length("__payload") >= LEAST_SHARED).groupBy("__digest").agg(F.min("__id").alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    known = sized(materialize(shared, "shared-payloads"))
    folder = shared_path(pages.sparkSession, "archives")
    target, root = filesystem(folder)
    target.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, base = filesystem(folder)
        name, out, packer, raw, count = "", None, None, 0, 0

        def close() -> pa.RecordBatch:
            out.write(packer.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], names=["path", "records"])

        for b in batches:
            for page_id, url, body, digest, first in zip(*(b.column(k) for k in range(5)), strict=True):
                page_id, first = page_id.as_py(), first.as_py()
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, packer, raw, count = to.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), 0, 1
                    out.write(packer.compress(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"software: faultloom\r\n")))
                one = page_record(page_id, url.as_py(), body.as_py(), digest.as_py(), first, first is None or page_id == first, date)
                out.write(packer.compress(one))
                raw, count = raw + len(one), count + 1
                if raw >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    made = rows.join(known, "__digest", "left").select("__id", "__url", "__payload", "__digest", "__first").mapInArrow(write, "path string, records long")
    return materialize(made.select(F.concat(F.lit(f"{folder}/"), "path").alias("path"), "records"), "archive-table")


def normalise(archives: DataFrame) -> DataFrame:
    """Normalised copies of the archives in a table (path ...): (path, index, records), materialised; none for an empty table."""
    folder = shared_path(archives.sparkSession, "normalised")
    target, root = filesystem(folder)
    target.create_dir(root, recursive=True)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                (old, old_path), (new, base), name = filesystem(path), filesystem(folder), uuid.uuid4().hex
                with old.open_input_stream(old_path, compression=None) as source, new.open_output_stream(f"{base}/{name}.warc.gz", compression=None) as out, new.open_output_stream(f"{base}/{name}.idx", compression=None) as index:
                    count = normalise_stream(source, out, index)
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}.warc.gz"]), pa.array([f"{folder}/{name}.idx"]), pa.array([count], pa.int64())], names=["path", "index", "records"])

    spread = archives.repartition(max(1, archives.count()))
    return materialize(spread.select("path").mapInArrow(rewrite, "path string, index string, records long"), "normalised-table")


def read_archives(normalised: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per page record, each read at its offset: page_id, payload_bytes, payload_digest, record_type, refers_to, payload.

    The payload of a response is hashed again and must have the digest that the record names; a revisit has no payload,
    and without payloads no row has one. An empty table gives no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, index in zip(b.column("path").to_pylist(), b.column("index").to_pylist(), strict=True):
                store, at = filesystem(path)
                with store.open_input_stream(filesystem(index)[1], compression=None) as f:
                    entries = [x.split(b"\t") for x in f.read().splitlines()]
                with store.open_input_file(at) as f:
                    rows, held = [], 0
                    for offset, size, kind, _ in entries:
                        if kind == b"warcinfo":
                            continue
                        f.seek(int(offset))
                        head, block = read_record(f.read(int(size)))
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length, digest = int(parse_head(http)["content-length"]), head["warc-payload-digest"].removeprefix("sha256:")
                        whole = kind == b"response"
                        if whole and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"a record of {path} at {int(offset)} does not have its digest")
                        number = lambda k: int(head[k]) if k in head else None  # noqa: B023, E731
                        rows.append((number("warc-page-id"), length, digest, kind.decode(), number("warc-refers-to-page-id"), payload if whole and payloads else None))
                        held += len(payload) if payloads else 0
                        if len(rows) >= HELD_ROWS or held >= HELD_BYTES:
                            yield _rows(rows)
                            rows, held = [], 0
                    yield _rows(rows)

    spread = normalised.repartition(max(1, normalised.count()))
    return spread.select("path", "index").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names, types = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=list(names))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages as monolithic archives, normalise these, and read every record back by its index entry.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to. Null html is an empty payload, a
    null url becomes about:blank, a page without id is stored with none. Other columns are ignored; no pages, no rows.
    The monolithic archives are removed once their normalised copies are complete.
    """
    archives = write_archives(pages, id_col, url_col, html_col)
    normalised = normalise(archives)
    one = archives.select("path").first()
    if one:
        store, path = filesystem(one[0].rpartition("/")[0])
        store.delete_dir(path)
    return read_archives(normalised, payloads=False).drop("payload")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS n, sha256(h) AS s FROM p),
f AS (SELECT page_id, n, s, min(page_id) OVER (PARTITION BY s) AS first FROM d)
SELECT page_id, n AS payload_bytes, s AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

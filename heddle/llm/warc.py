"""WARC archives: one gzip member for each record, written to shared files and read back sequentially.

The reader inflates a member piece by piece, frames the block by its content length and verifies block and payload
digests on the way; it holds one read block and one header at a time, never an archive.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import materialise, scratch

#: Compressed bytes after which a writer begins the next archive.
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 16
DATE = "2000-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that is cut short, badly framed, or whose digests don't match."""


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def open_file(uri: str, mode: str) -> BinaryIO:
    """A file of the shared folder: a mounted path, or any file system that pyarrow knows by URI."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        path = unquote(parts.path)
        if mode == "wb":
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if mode == "wb":
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(path)
    return system.open_input_stream(path)


def record_bytes(kind: str, record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP header, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%~"),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(hashlib.sha1(block).digest())}",
        "Content-Type: application/http;msgtype=response",
    ]
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <{refers_to}>")
    head.append(f"Content-Length: {len(block)}")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


class _Inflated:
    """The bytes of an archive, inflated member by member as they are asked for."""

    def __init__(self, f: BinaryIO) -> None:
        self.f, self.raw, self.z, self.buf = f, b"", None, bytearray()

    def next_member(self) -> bool:
        """Goes to the next member; False at the archive's end."""
        if self.z is not None and (self.buf or self.fill()):
            raise WarcError("bytes after a record's end inside its member")
        if not self.raw:
            self.raw = self.f.read(READ_BYTES)
        self.z = zlib.decompressobj(31)
        return bool(self.raw)

    def fill(self) -> bool:
        """Inflates some more of this member into the buffer; False at the member's end."""
        while not self.z.eof:
            self.raw = self.raw or self.f.read(READ_BYTES)
            if not self.raw:
                raise WarcError("the archive ends inside a member")
            try:
                got = self.z.decompress(self.raw, READ_BYTES)
            except zlib.error as e:
                raise WarcError(f"bad gzip member: {e}") from e
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if got:
                self.buf += got
                return True
        return False

    def header(self, most: int = 1 << 20) -> bytes:
        """Up to and without the next empty line."""
        while (end := self.buf.find(b"\r\n\r\n")) < 0:
            if len(self.buf) > most or not self.fill():
                raise WarcError("a header without an end")
        out = bytes(self.buf[:end])
        del self.buf[: end + 4]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if not self.buf and not self.fill():
                raise WarcError("a block is shorter than its content length")
            part = bytes(self.buf[:n])
            del self.buf[: len(part)]
            n -= len(part)
            yield part


@dataclass
class Record:
    headers: dict[str, str]
    http_length: int
    payload_bytes: int
    payload_digest: str
    payload: bytes | None


def read_records(f: BinaryIO, payloads: bool = True) -> Iterator[Record]:
    """The archive's records in order. With payloads False a payload is hashed and dropped piece by piece.

    Raises WarcError for a truncated or corrupt archive, and for a block or payload digest that does not match.
    """
    inflated = _Inflated(f)
    while inflated.next_member():
        lines = inflated.header().decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise WarcError(f"not a WARC record: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        if not (length := headers.get("content-length", "")).isdigit():
            raise WarcError("a record without content length")
        block, body, kept = hashlib.sha1(), hashlib.sha1(), []
        http, size, http_length = b"", 0, -1
        for part in inflated.take(int(length)):
            block.update(part)
            if http_length < 0:
                http += part
                if (end := http.find(b"\r\n\r\n")) < 0:
                    continue
                part = http[end + 4 :]
                fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http[:end].decode("latin-1").split("\r\n")[1:])}
                http_length = int(fields.get("content-length", 0))
            body.update(part)
            size += len(part)
            if payloads:
                kept.append(part)
        if b"".join(inflated.take(4)) != b"\r\n\r\n":
            raise WarcError("a record without its closing lines")
        if (said := headers.get("warc-block-digest")) and said != f"sha1:{base32_sha1(block.digest())}":
            raise WarcError("a block digest that does not match")
        found = base32_sha1(body.digest())
        if headers.get("warc-type") == "response":
            if size != http_length:
                raise WarcError("a payload is not as long as its HTTP header says")
            if (said := headers.get("warc-payload-digest")) and said != f"sha1:{found}":
                raise WarcError("a payload digest that does not match")
        yield Record(headers, http_length, size, found, b"".join(kept) if payloads else None)


def _page_uri(page_id: object) -> str:
    return f"urn:uuid:{uuid.uuid4()}" if page_id is None else f"urn:page:{page_id}"


def _page_id(uri: str | None) -> int | None:
    return int(uri.strip("<>")[9:]) if uri and uri.startswith("<urn:page:") else None


def write_archives(pages: DataFrame, folder: str, min_payload: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each row of pages(page_id, url, html) below folder; returns the manifest (path, n_records).

    Of records with equal payloads of at least min_payload bytes, that with the smallest page_id is a response and the
    others revisit it; smaller payloads are all responses. A null html is an empty payload, a null url is about:blank.
    Rows that repeat the smallest page_id are all responses; a null page_id revisits whatever its payload has, and is a
    response where no row with that payload has an id. Files carry the attempt's own name and only the manifest's count,
    so a task that runs twice leaves no record twice.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "sha2": F.sha2("payload", 256)})
    first = rows.groupBy("sha1", "sha2").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"), F.max(F.length("payload")).alias("size"))
    first = first.where(f"n > 1 and size >= {int(min_payload)}").select("sha1", "sha2", "first_id")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    rows = rows.join(first, ["sha1", "sha2"], "left").select("page_id", "url", "payload", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number, out, path, n, size = 0, None, "", 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(i) for i in range(4)), strict=True):
                if out is None:
                    path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
                    out, n, size, number = open_file(path, "wb"), 0, 0, number + 1
                body, page_id, refers_to = payload.as_py(), page_id.as_py(), refers_to.as_py()
                kind = "response" if refers_to is None else "revisit"
                record = record_bytes(kind, _page_uri(page_id), url.as_py(), body, base32_sha1(hashlib.sha1(body).digest()), None if refers_to is None else _page_uri(refers_to))
                out.write(record)
                n, size = n + 1, size + len(record)
                if size >= archive_bytes:
                    out.close()
                    done.append((path, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "n_records"])

    return materialise(rows.mapInArrow(run, "path string, n_records long"), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record of the manifest's archives: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    One archive is one unit of work. The payload is null for revisits, and for all records with payloads False.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, n_records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = 0
                with open_file(path, "rb") as f:
                    for part in _chunks(map(_row, read_records(f, payloads)), lambda r: 200 + len(r[6] or b"")):
                        n += len(part)
                        yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r, strict=True)) for r in part], _SCHEMA)
                if n != n_records:
                    raise WarcError(f"{path} has {n} records, not {n_records}")

    tasks = max(1, min(manifest.count(), 4096))  # given as a number, so that small manifest partitions aren't put together
    spread = manifest.select("path", "n_records").repartition(tasks, "path")
    return spread.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def _row(r: Record) -> tuple:
    kind = r.headers.get("warc-type", "")
    digest = r.headers.get("warc-payload-digest", "").removeprefix("sha1:") if kind == "revisit" else r.payload_digest
    url = unquote(r.headers.get("warc-target-uri", ""))
    return (_page_id(r.headers.get("warc-record-id")), url, kind, _page_id(r.headers.get("warc-refers-to")), r.http_length, digest, r.payload if kind == "response" else None)


def _chunks(rows: Iterator[tuple], weight: Callable[[tuple], int], most: int = 8 << 20) -> Iterator[list[tuple]]:
    part, size = [], 0
    for r in rows:
        part.append(r)
        size += weight(r)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def warc_round_trip(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back, without the payloads."""
    manifest = write_archives(pages, scratch(pages.sparkSession, "warc"), min_payload)
    return read_archives(manifest, payloads=False).drop("payload")

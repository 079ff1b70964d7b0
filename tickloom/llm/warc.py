"""WARC archives: writing, normalising to one gzip member per record, and reading by offset.

`write_archives` makes whole-file gzip streams, as many crawlers' tools do.  `normalise` inflates such a
stream once, from front to back, and writes each record as a gzip member of its own next to a sidecar
index of offsets, so that a record can then be read without the bytes before it.  `read_archives` reads
by that index.  Bytes go through in pieces; a task holds about a megabyte of records, or one record that is larger.

Files are written under a unique name and only then listed in a table that Spark commits, so a task that
is repeated or runs twice leaves at most a file that nobody refers to.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.batches import slices
from tickloom.llm.store import table

CHUNK = 1 << 20
#: Records of an archive: a task starts a new file beyond so many bytes of payload.
ARCHIVE_BYTES = 64 << 20
_BREAK = b"\r\n\r\n"


def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI, or of a plain local path, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{quote(uri)}")


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: object) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record_bytes(page_id: object, url: str | None, payload: bytes, refers_to: object, revisit: bool) -> bytes:
    """One uncompressed record; a revisit keeps the digest and length of its payload, not the payload."""
    body = b"" if revisit else payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {quote(url or '', safe='%/:?#[]@!$&()*+,;=~-._')}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(body)}",
    ]
    if revisit:
        lines[5:5] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(lines).encode() + _BREAK + body + _BREAK


def headers(raw: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in raw.decode().split("\r\n")[1:] if line)


class _Inflater:
    """Bytes of a gzip file of any number of members, inflated once and given out in order."""

    def __init__(self, file: BinaryIO):
        self.file, self.zip, self.held, self.over = file, zlib.decompressobj(31), bytearray(), False

    def _more(self) -> bool:
        raw = self.zip.unconsumed_tail
        if self.zip.eof:
            raw = self.zip.unused_data or self.file.read(CHUNK)
            if not raw:
                return False
            self.zip = zlib.decompressobj(31)
        elif not raw:
            raw = self.file.read(CHUNK)
            if not raw:
                raise EOFError("the gzip stream ends early")
        self.held += self.zip.decompress(raw, CHUNK)
        return True

    def head(self) -> bytes | None:
        """The next record's header block, without its empty line; None at the end."""
        while (at := self.held.find(_BREAK)) < 0:
            if not self._more():
                if self.held.strip():
                    raise EOFError("the archive ends inside a header")
                return None
        out = bytes(self.held[:at])
        del self.held[:at + 4]
        return out

    def take(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.held and not self._more():
                raise EOFError("the archive ends inside a record")
            part = bytes(self.held[:min(size, CHUNK)])
            del self.held[:len(part)]
            size -= len(part)
            yield part


def normalise_stream(source: BinaryIO, target: BinaryIO) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Writes every record of `source` as its own member; (offset, length, headers) of each."""
    stream, offset = _Inflater(source), 0
    while (head := stream.head()) is not None:
        fields = headers(head)
        member, size = zlib.compressobj(6, zlib.DEFLATED, 31), 0
        for part in (head, _BREAK):
            size += target.write(member.compress(part))
        for part in stream.take(int(fields["Content-Length"]) + len(_BREAK)):
            size += target.write(member.compress(part))
        size += target.write(member.flush())
        yield offset, size, fields
        offset += size


def read_member(file: pyarrow.NativeFile, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of the record at an offset."""
    file.seek(offset)
    raw = zlib.decompress(file.read(length), 31)
    head, _, body = raw.partition(_BREAK)
    fields = headers(head)
    return fields, body[:int(fields["Content-Length"])]


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes one record per row into whole-file gzip archives under `folder`; a table of (path, records).

    The payload is the html in UTF-8, a null is empty.  Among records of equal payload with at least
    `min_bytes` bytes, the one with the smallest id is the response and the others revisit it; smaller
    ones are all responses.  Repeated rows of that smallest id are all responses; null ids come last.  An
    empty table writes no archive; a page of any length is one record; other columns are left out, so no
    name can clash.
    """
    html = F.coalesce(pages[html_col].cast("string"), F.lit(""))
    page_id = pages[id_col].cast("long")
    rows = pages.select(page_id.alias("page_id"), pages[url_col].cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    # The first page of each payload, combined before the shuffle; a payload that no other page has stays out.
    first = (
        rows.filter(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1").select(F.col("digest").alias("__digest"), "first")
    )
    joined = rows.join(first, F.col("digest") == F.col("__digest"), "left")
    revisit = F.col("__digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    records = joined.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        path = out = member = None
        count = held = 0
        for row in (r for whole in batches for part in slices(whole, 2) for r in part.to_pylist()):
            if out is None:
                path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                out, member, count, held = system.open_output_stream(path, compression=None), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
            payload = row["html"].encode()
            out.write(member.compress(record_bytes(row["page_id"], row["url"], payload, row["refers_to"], row["revisit"])))
            count, held = count + 1, held + len(payload)
            if held > ARCHIVE_BYTES:
                out.write(member.flush())
                out.close()
                out = None
                yield pa.RecordBatch.from_pydict({"path": [path], "records": [count]}, pa.schema([("path", pa.string()), ("records", pa.int64())]))
        if out is not None:
            out.write(member.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [count]}, pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return table(records.mapInArrow(write, "path string, records long"), "archives")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites each archive of `archives` (a `path` column) under `folder`, with a sidecar `.idx` of JSON lines
    beside it; a table of (path, offset, length, record_id), one row per record."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            for source in batch.column(0).to_pylist():
                path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                with system.open_input_stream(source, compression=None) as raw, system.open_output_stream(path, compression=None) as out, \
                        system.open_output_stream(path + ".idx", compression=None) as index:
                    rows = []
                    for offset, length, fields in normalise_stream(raw, out):
                        entry = {"offset": offset, "length": length, "record_id": fields["WARC-Record-ID"]}
                        index.write(json.dumps(entry).encode() + b"\n")
                        rows.append({"path": path} | entry)
                        if len(rows) == 4096:
                            yield _index_batch(rows)
                            rows = []
                if rows:
                    yield _index_batch(rows)

    # One archive is one stream and so one task's work; archives are bounded by ARCHIVE_BYTES and a record.
    spread = archives.select("path").repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism * 4), "path")
    return table(spread.mapInArrow(rewrite, "path string, offset long, length long, record_id string"), "warc-index")


def _index_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string())]))


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """One row per indexed record: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload_ok.

    Length and digest are those of the full payload: a response's are taken from the bytes read, and
    `payload_ok` says that its header agrees; a revisit's are those that its header keeps.
    """

    def number(text: str) -> int | None:
        value = text.removeprefix("<urn:page:").removesuffix(">")
        return int(value) if value else None

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload_ok", pa.bool_())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = opened(folder)
        path = file = None
        for batch in batches:
            rows = []
            for entry in batch.to_pylist():
                if entry["path"] != path:
                    if file is not None:
                        file.close()
                    path = entry["path"]
                    file = system.open_input_file(path)
                fields, payload = read_member(file, entry["offset"], entry["length"])
                claimed = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                response = fields["WARC-Type"] == "response"
                found = digest(payload) if response else claimed
                size = len(payload) if response else int(fields["X-Payload-Length"])
                rows.append({
                    "page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"],
                    "refers_to": number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
                    "payload_bytes": size, "payload_digest": found, "payload_ok": found == claimed and size == int(fields["X-Payload-Length"]),
                })
            yield pa.RecordBatch.from_pylist(rows, schema)
        if file is not None:
            file.close()

    kinds = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload_ok boolean"
    return index.select("path", "offset", "length").mapInArrow(read, kinds)

"""WARC archives: a writer with revisit records, and a splittable reader.

Every record is a gzip member of its own. The reader cuts files into byte
ranges. A task looks for the gzip magic in its range, accepts a candidate only
if what it decodes begins with a WARC version line and complete headers, and
owns the records that start inside its range, reading past the range's end to
finish the last one. So each record is read exactly once, however the files are
cut. From its first record on, a task goes from one to the next without a gap, and
looks whether a record follows its last one: bytes between records, damaged
records and cut off ones are errors, whichever range they lie in. (Payloads that
hold whole compressed records as they are would be taken for records; text in
UTF-8 cannot hold the magic.)

Files lie in a folder that driver and executors share; they are opened with
Arrow's file systems, by URI.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweave.llm.common import bound_arrow_batches, new_path, stash

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
SPLIT_BYTES = 4 << 20
#: Tasks that read archives, at most; a task then reads several ranges.
MAX_READERS = 50_000
FEED = 1 << 14
READ = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"  # archives of equal tables are equal


# ---- records -----------------------------------------------------------


def _identity(page: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}')}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member; a revisit keeps the HTTP headers, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_identity(page, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=_PRINTABLE)}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if page is not None:
        head.append(f"Page-ID: {page}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_identity(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


_PRINTABLE = "".join(chr(c) for c in range(33, 127))


def headers(data: bytes) -> tuple[dict[str, str], int] | None:
    """The headers of a record and where its block starts; None if data doesn't begin with them."""
    if not data.startswith(VERSION):
        return None
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    found = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return None
        found[name.strip().lower()] = value.strip()
    return (found, end + 4) if "warc-type" in found and found.get("content-length", "").isdigit() else None


def parse(data: bytes) -> dict:
    """A record's fields; a response's digest is computed anew and must be the recorded one."""
    found, start = headers(data)
    block = data[start : start + int(found["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = found["warc-payload-digest"].removeprefix("sha1:")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if found["warc-type"] == "response":
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"record {found['warc-record-id']}: the payload is not the recorded one")
    page, refers = found.get("page-id"), found.get("refers-to-page-id")
    return {
        "page_id": None if page is None else int(page),
        "url": found["warc-target-uri"],
        "payload": payload if found["warc-type"] == "response" else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": found["warc-type"],
        "refers_to": None if refers is None else int(refers),
    }


# ---- reading -----------------------------------------------------------


class ByteRange:
    """Bytes of a file from a position on, read as they are asked for."""

    def __init__(self, file, start: int, size: int) -> None:
        self.file, self.base, self.size, self.data = file, start, size, bytearray()

    def upto(self, end: int) -> None:
        end = min(end, self.size)
        while self.base + len(self.data) < end:
            self.file.seek(self.base + len(self.data))
            self.data += self.file.read(max(READ, end - self.base - len(self.data)))

    def get(self, start: int, end: int) -> bytes:
        self.upto(end)
        return bytes(self.data[start - self.base : end - self.base])

    def find(self, start: int, end: int) -> int:
        """The first magic that starts in [start, end), or -1."""
        self.upto(end + len(MAGIC) - 1)
        at = self.data.find(MAGIC, start - self.base, end - self.base + len(MAGIC) - 1)
        return at if at < 0 else at + self.base


def member(source: ByteRange, start: int) -> tuple[bytes, int] | None:
    """The decoded gzip member at start, and where it ends; None if it is no WARC record.

    What begins with a WARC version line is a record, however long its headers
    are: if it is cut off, damaged, has no complete headers or no record behind
    it, that is an error.
    """
    inflate, out, at = zlib.decompressobj(31), bytearray(), start
    while not inflate.eof:
        part = source.get(at, at + FEED)
        try:
            out += inflate.decompress(part)
        except zlib.error:
            if out.startswith(VERSION):
                raise ValueError(f"damaged record at byte {start}") from None
            return None
        at += len(part)
        if not out.startswith(VERSION) and (len(out) >= len(VERSION) or inflate.eof or not part):
            return None
        if not part and not inflate.eof:
            raise ValueError(f"cut off record at byte {start}")
    end = at - len(inflate.unused_data)
    data = bytes(out)
    if headers(data) is None:
        raise ValueError(f"record without complete headers at byte {start}")
    if end < source.size and source.get(end, end + len(MAGIC)) != MAGIC:
        raise ValueError(f"no record at byte {end}")
    return data, end


def begins(source: ByteRange, start: int) -> bool:
    """Whether a WARC record begins at start."""
    inflate, out, at = zlib.decompressobj(31), b"", start
    try:
        while len(out) < len(VERSION) and at < source.size:
            out += inflate.decompress(source.get(at, at + 256), len(VERSION))
            at += 256
    except zlib.error:
        return False
    return out.startswith(VERSION)


def records_in(file, size: int, start: int, end: int) -> Iterator[dict]:
    """The records that start in [start, end) of a file."""
    source, at, chained = ByteRange(file, start, size), start, start == 0
    while at < min(end, size):
        if not chained and (at := source.find(at, end)) < 0:
            return  # the range lies within a record that began before it
        found = member(source, at)
        if found is not None:
            yield parse(found[0])
            at, chained = found[1], True
        elif chained:
            raise ValueError(f"no record at byte {at}")
        else:
            at += 1
    if chained and at < size and not begins(source, at):
        raise ValueError(f"no record at byte {at}")


FIELDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
_ARROW = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)


def _reader(columns: list[str]):
    schema = pa.schema([_ARROW.field(c) for c in columns])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(r["path"])
                held, n = [], 0
                with store.open_input_file(path) as file:
                    for x in records_in(file, r["size"], r["start"], r["end"]):
                        held.append({c: x[c] for c in columns})
                        n += 100 + sum(len(x[c] or "") for c in ("url", "payload") if c in columns)
                        if n > READ:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, n = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return read


def read_warc(files: DataFrame, columns: list[str] | None = None, split: int = SPLIT_BYTES) -> DataFrame:
    """The records of files (path as URI, size), read by byte ranges of split bytes."""
    columns = columns or _ARROW.names
    ranges = files.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(split))).alias("start"))
    ranges = ranges.withColumn("end", F.least(F.col("start") + split, "size"))
    # A range is a short row that stands for much work: with a stated number, adaptive execution doesn't merge the tasks.
    ranges = ranges.repartition(min(MAX_READERS, max(1, ranges.count())))
    kinds = dict(x.rsplit(" ", 1) for x in FIELDS.split(", "))
    return ranges.mapInArrow(_reader(columns), ", ".join(f"{c} {kinds[c]}" for c in columns))


# ---- writing -----------------------------------------------------------


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        draft, n = f"{root}/.{name}.{uuid.uuid4().hex}", 0
        out = None
        for batch in batches:
            for r in batch.to_pylist():
                out = out or store.open_output_stream(draft)
                digest = base64.b32encode(bytes.fromhex(r["digest"])).decode()
                data = record(r["page_id"], r["url"], r["payload"], digest, r["first"], r["revisit"])
                out.write(data)
                n += len(data)
        if out:
            out.close()
            store.move(draft, f"{root}/{name}")  # an attempt that is lost leaves a draft that nobody reads
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "size": n}], pa.schema([("path", pa.string()), ("size", pa.int64())]))

    return write


def write_warc(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) and returns the files: path, size.

    The payload is html in UTF-8, of a null nothing. Of rows with equal payloads of
    at least least_bytes, those with the smallest page_id are responses, the
    others revisits of it; smaller payloads are all responses. A null page_id is
    larger than all others. An empty table writes no file. Columns of pages other
    than these three are not read.
    """
    spark = pages.sparkSession
    bound_arrow_batches(spark)
    folder = folder or new_path(spark, "warc")
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    first = rows.groupBy("digest").agg(F.min("page_id").alias("first"))
    revisit = (F.octet_length("payload") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    dealt = rows.join(first.hint("merge"), "digest").withColumn("revisit", revisit)
    return stash(dealt.mapInArrow(_writer(folder), "path string, size long"), "warc-files")

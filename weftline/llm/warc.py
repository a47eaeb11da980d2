"""WARC archives and their chunked record table.

Writing: every page is one gzip member: a response, or a revisit that names the
response with an equal payload and the smallest page_id.  Payloads are cut into
chunks on their way to the compressor.  Reading streams an archive through a
decompressor in blocks of ``CHUNK`` bytes and yields rows of (page_id, chunk number,
bytes so far, digest so far); no record is ever held whole, whatever its size.

Defined cases: a null html is an empty payload; payloads of fewer than
``min_revisit`` bytes are never revisited; a null page_id is written as such and
counts as larger than all others; if rows repeat the smallest page_id of a payload,
each is a response; a null url has no target header; line breaks and other controls
in urls are percent-encoded; an empty table makes no archive.

Scale: a task writes its rows to archives of about ``ARCHIVE`` bytes in the shared
folder, under a name of its partition, first as a temporary file of its attempt: a lost task is
repeated with the same result.  Pages whose payload may repeat,
by a Bloom filter of bounded size, are looked up by digest through ``salted_lookup``: a
payload that a third of all pages have is no hot task; all others aren't shuffled.
A header of any length is read; it is the only part of a record that is held whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_by, salted_lookup, saved, scratch_path

CHUNK = 1 << 20
ARCHIVE = 256 << 20
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def payload_digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _header(page_id: int | None, url: str | None, size: int, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else size)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + http


def write_record(out, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, date: str = "1970-01-01T00:00:00Z", level: int = 1) -> int:
    """Write one gzip member to ``out``; returns its compressed size."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    revisit = refers_to is not None
    n = out.write(z.compress(_header(page_id, url, len(payload), digest, refers_to, revisit, date))) or 0
    if not revisit:
        view = memoryview(payload)
        for a in range(0, len(view), CHUNK):
            n += out.write(z.compress(view[a : a + CHUNK])) or 0
    return n + (out.write(z.compress(b"\r\n\r\n") + z.flush()) or 0)


class _Members:
    """The bytes of concatenated gzip members, read in blocks."""

    def __init__(self, source):
        self.source, self.z, self.rest, self.open = source, zlib.decompressobj(31), b"", False

    def read(self, n: int) -> bytes:
        """Up to n bytes; empty at the end of the archive."""
        while True:
            if not self.rest:
                self.rest = self.source.read(CHUNK)
                if not self.rest:
                    if self.open:
                        raise ValueError("archive ends within a member")
                    return b""
            got, self.open = self.z.decompress(self.rest, n), True
            if self.z.eof:
                self.rest, self.z, self.open = self.z.unused_data, zlib.decompressobj(31), False
            else:
                self.rest = self.z.unconsumed_tail
            if got:
                return got


class _Lines:
    """Buffered reading of headers and bodies from a stream of bytes."""

    def __init__(self, members: _Members):
        self.members, self.held = members, b""

    def until(self, mark: bytes) -> bytes | None:
        parts, tail = [self.held], self.held
        while (at := tail.find(mark)) < 0:
            more = self.members.read(65536)
            if not more:
                if b"".join(parts).strip():
                    raise ValueError("archive ends within a header")
                return None
            parts.append(more)
            tail = tail[-len(mark) + 1 :] + more  # the mark may begin in what came before
        whole = b"".join(parts)
        at += len(whole) - len(tail)
        self.held = whole[at + len(mark) :]
        return whole[:at]

    def some(self, n: int) -> bytes:
        if self.held:
            out, self.held = self.held[:n], self.held[n:]
            return out
        got = self.members.read(min(n, CHUNK))
        if not got:
            raise ValueError("archive ends within a record")
        return got


def _fields(head: bytes) -> dict[str, str]:
    pairs = (x.split(":", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, v in pairs}


def _page(urn: str | None) -> int | None:
    name = (urn or "").strip("<>").removeprefix("urn:page:")
    return int(name) if name.lstrip("-").isdigit() else None


def read_chunks(source, with_data: bool = False) -> Iterator[dict]:
    """Chunk rows of an archive: at least one per record, the last with ``last`` set.

    ``sha1`` is the digest of the record's payload up to the end of the chunk; a
    revisit has one chunk without bytes, whose size and digest are the header's.
    """
    lines = _Lines(_Members(source))
    while (head := lines.until(b"\r\n\r\n")) is not None:
        f = _fields(head.lstrip(b"\r\n"))
        left = int(f["content-length"])
        http = lines.until(b"\r\n\r\n")
        left -= len(http) + 4
        size = int(_fields(http)["content-length"])
        row = {"page_id": _page(f["warc-record-id"]), "record_type": f["warc-type"], "url": f.get("warc-target-uri"), "refers_to": _page(f.get("warc-refers-to"))}
        claimed = f["warc-payload-digest"].removeprefix("sha1:")
        if f["warc-type"] == "revisit":
            yield row | {"chunk_no": 0, "n_bytes": 0, "bytes_so_far": size, "digest_so_far": claimed, "last": True, "data": None}
        else:
            sha, done, number = hashlib.sha1(), 0, 0
            while True:
                part = bytearray()
                while left and len(part) < CHUNK:
                    got = lines.some(min(left, CHUNK - len(part)))
                    part += got
                    left -= len(got)
                sha.update(part)
                done += len(part)
                digest = payload_digest(sha.digest())
                if not left and (digest != claimed or done != size):
                    raise ValueError(f"record of page {row['page_id']} is damaged")
                yield row | {"chunk_no": number, "n_bytes": len(part), "bytes_so_far": done, "digest_so_far": digest, "last": not left, "data": bytes(part) if with_data else None}
                number += 1
                if not left:
                    break
        if lines.until(b"\r\n\r\n") != b"":
            raise ValueError("record isn't closed")


def revisits(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """page_id, url, html, sha1 (hex) and refers_to, null for responses."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    narrow = rows.select("page_id", "sha1", F.octet_length("html").alias("size"))
    same = saved(narrow.where(F.col("size") >= min_revisit).groupBy("sha1").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("head")).where("n > 1"), "payloads")
    rows = rows.withColumn("repeats", held_by(same, ["sha1"]))
    # payloads that no other page has stay where they are
    found = salted_lookup(rows.where("repeats").drop("repeats"), same, ["sha1"], "n", narrow.count())
    found = found.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("head")), F.col("head"))).drop("head")
    return found.unionByName(rows.where("not repeats").drop("repeats").withColumn("refers_to", F.lit(None).cast("long")))


def write_archives(pages: DataFrame, folder: str, min_revisit: int = 0) -> DataFrame:
    """Write all pages below ``folder``; returns path and number of records of each archive (written)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        out, count, size, number = None, 0, 0, 0
        made: list[tuple[str, int]] = []

        def close() -> None:
            name = f"{root}/part-{task.partitionId():05d}-{number:03d}.warc.gz"
            out.close()
            fs.move(temporary, name)
            made.append((f"{folder}/{name[len(root) + 1 :]}", count))

        for batch in batches:
            for page_id, url, html, sha1, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    temporary = f"{root}/.{task.partitionId()}-{number}-{task.taskAttemptId()}-{uuid.uuid4().hex}"
                    out, count, size = fs.open_output_stream(temporary), 0, 0
                size += write_record(out, page_id, url, html.encode("utf-8", "surrogatepass"), payload_digest(bytes.fromhex(sha1)), refers_to)
                count += 1
                if size >= ARCHIVE:
                    close()
                    out, number = None, number + 1
        if out is not None:
            close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in made]), pa.array([n for _, n in made], pa.int64())], names=["path", "records"])

    return saved(revisits(pages, min_revisit).mapInArrow(run, "path string, records long"), "archives")


_CHUNKS = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int32()), ("n_bytes", pa.int64()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_()), ("data", pa.binary())])


def chunk_table(archives: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunked record table of archives (path): page_id, record_type, url, refers_to, chunk_no, ..., data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = pafs.FileSystem.from_uri(path)
                rows, held = [], 0
                with fs.open_input_stream(at, compression=None) as source:
                    for row in read_chunks(source, with_data):
                        rows.append(row)
                        held += 200 + (row["n_bytes"] if with_data else 0)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _CHUNKS)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _CHUNKS)

    schema = "page_id long, record_type string, url string, refers_to long, chunk_no int, n_bytes long, bytes_so_far long, digest_so_far string, last boolean, data binary"
    files = archives.select("path")
    return files.repartition(max(1, min(files.count(), 4096))).mapInArrow(run, schema)


def archived(pages: DataFrame, min_revisit: int = 0, folder: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, chunks: all pages, read back from archives."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    chunks = chunk_table(write_archives(pages, folder, min_revisit), with_data=False)
    last = chunks.where("last")
    return last.select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to", (F.col("chunk_no") + 1).alias("chunks"))

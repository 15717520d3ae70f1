"""WARC archives: records as gzip members, payload revisits, and a splittable reader.

A reader task gets a byte range of a file. It looks for gzip magic in it, takes a place for a member only if what it
unpacks to there begins with a WARC header, and then owns every record that starts inside its range, to
the last byte even if that lies beyond it.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.llm.common import batch, parts_for
from newsflow.session import scratch_path

MAGIC = b"\x1f\x8b\x08"
# Payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
SPLIT_BYTES = 8 << 20
READ_BYTES = 1 << 20
# A header longer than this is no WARC header.
HEADER_BYTES = 64 << 10
_VERSION = re.compile(rb"WARC/\d")


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or a plain path."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


# ---- records

def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def page_of(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def page_record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, revisit: bool) -> bytes:
    """Response or revisit of a page. A revisit keeps the HTTP header, which holds the payload's length, not the payload."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = re.sub(r"[\r\n]+", " ", url or "")
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)),
               ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=response"),
               ("WARC-Payload-Digest", f"sha1:{digest}")]
    if revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to))]
        return member(headers, http)
    return member(headers, http + payload)


# ---- writing

def with_revisits(pages: DataFrame, id_col: str = "page_id", text_col: str = "html") -> DataFrame:
    """Add refers_to and revisit: of equal payloads of REVISIT_BYTES or more the one with the largest id is the response.

    Rows without an id are responses of their own; repeated rows of the largest id are all responses. Largest
    ids are combined before the shuffle and joined back on (digest, length); a payload many pages share is split by the
    optimizer's skew join, as both sides are plain exchanges.
    """
    payload = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    size = F.octet_length(payload)
    keyed = pages.withColumns({"_digest": F.when((size >= REVISIT_BYTES) & F.col(id_col).isNotNull(), F.sha1(payload))})
    path = scratch_path(pages.sparkSession, "digests")
    known = keyed.where("_digest IS NOT NULL").groupBy("_digest").agg(F.max(id_col).alias("_last"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    known.select("_digest", "_last").write.parquet(path)
    joined = keyed.join(pages.sparkSession.read.parquet(path), "_digest", "left")
    revisit = F.col("_last").isNotNull() & (F.col(id_col) != F.col("_last"))
    return joined.withColumns({"revisit": revisit, "refers_to": F.when(revisit, F.col("_last"))}).drop("_digest", "_last")


def write_pages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """Write a record per page into archives below `folder`, a place all executors share; (path, length) of each archive.

    Every task attempt writes a file of its own, and the list, a table beside the archives, names those of the attempts
    that counted: a task that is run again leaves no record twice.
    """
    columns = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(text_col).alias("html"))
    marked = with_revisits(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        context = TaskContext.get()
        name = f"{base}/pages-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        size = 0
        with store.open_output_stream(name, compression=None) as out:
            for b in batches:
                columns = [b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "revisit")]
                for row in zip(*columns):
                    data = page_record(*row)
                    out.write(data)
                    size += len(data)
        yield batch(path=[os.path.basename(name)], length=[size])

    listing = f"{folder}-list"
    marked.mapInArrow(run, "path string, length long").write.parquet(listing)
    return pages.sparkSession.read.parquet(listing).where("length > 0").select(F.concat(F.lit(folder + "/"), "path").alias("path"), "length")


# ---- reading

class Window:
    """Bytes of a file from a place on, read as they are asked for."""

    def __init__(self, file, start: int, length: int) -> None:
        self.file, self.length = file, length
        self.at, self.data = start, b""

    def get(self, start: int, n: int) -> bytes:
        """Up to n bytes from `start` on; what lies before it is dropped."""
        if not self.at <= start <= self.at + len(self.data):
            self.at, self.data = start, b""
        self.data, self.at = self.data[start - self.at:], start
        while len(self.data) < n and self.at + len(self.data) < self.length:
            self.file.seek(self.at + len(self.data))
            more = self.file.read(max(READ_BYTES, n - len(self.data)))
            if not more:
                break
            self.data += more
        return self.data[:n]


def unpack(window: Window, start: int, limit: int | None = None) -> tuple[bytes, int] | None:
    """(content, end) of the gzip member at `start`; with a limit only the first bytes and no end. None if it is no member."""
    unpacker, out, at = zlib.decompressobj(31), [], start
    size = 0
    try:
        while not unpacker.eof:
            data = window.get(at, READ_BYTES if limit is None else 4096)
            if not data:
                return None
            out.append(unpacker.decompress(data, limit or 0))
            size += len(out[-1])
            at += len(data)
            if limit and size >= min(limit, 5):
                return b"".join(out), -1
    except zlib.error:
        return None
    return b"".join(out), at - len(unpacker.unused_data)


def starts_record(window: Window, at: int) -> bool:
    """Whether a gzip member with a WARC header begins here."""
    found = unpack(window, at, 64)
    return found is not None and bool(_VERSION.match(found[0]))


def next_record(window: Window, at: int, end: int) -> int | None:
    """First place from `at` on, before `end`, at which a record begins."""
    while at < end:
        data = window.get(at, min(READ_BYTES, end - at) + len(MAGIC) - 1)
        found = data.find(MAGIC)
        if found < 0:
            at += max(1, len(data) - len(MAGIC) + 1)
            continue
        at += found
        if at >= end:
            return None
        if starts_record(window, at):
            return at
        at += 1
    return None


def hex_digest(value: str | None) -> str | None:
    """Bare hex form of a sha1 digest header, which is base 32."""
    name, _, digest = (value or "").partition(":")
    return base64.b32decode(digest).hex() if name == "sha1" and len(digest) == 32 else None


def parse(content: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers and block of a record."""
    head, gap, rest = content.partition(b"\r\n\r\n")
    if not gap or not _VERSION.match(head):
        return None
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    return headers, rest[:int(headers.get("content-length") or 0)]


def records(file, start: int, end: int, length: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, headers, block) of the records that start in [start, end)."""
    window = Window(file, start, length)
    at = next_record(window, start, end)
    while at is not None and at < end:
        found = unpack(window, at)
        parsed = parse(found[0]) if found else None
        if parsed is None:  # damaged: look for the next one behind it
            at = next_record(window, at + 1, end)
            continue
        yield at, *parsed
        at = found[1]
        if at < end and not starts_record(window, at):
            at = next_record(window, at, end)


def ranges(files: DataFrame, split: int = SPLIT_BYTES) -> DataFrame:
    """(path, length, start, end): the byte ranges of files (path, length)."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))
    return files.where("length > 0").select("path", "length", F.explode(starts).alias("start")).withColumn(
        "end", F.least(F.col("start") + split, "length"))


def read_records(files: DataFrame, split: int = SPLIT_BYTES) -> DataFrame:
    """(path, place, type, record_id, refers_to, url, digest_hex, http, payload) of all records of files (path, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, length, start, end in zip(*[b.column(c).to_pylist() for c in ("path", "length", "start", "end")]):
                store, place = open_store(path)
                rows, size = [], 0
                with store.open_input_file(place) as file:
                    for at, headers, block in records(file, start, end, length):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        rows.append((path, at, headers.get("warc-type"), headers.get("warc-record-id"), headers.get("warc-refers-to"),
                                     headers.get("warc-target-uri"), hex_digest(headers.get("warc-payload-digest")), http, payload))
                        size += len(block)
                        if size > 8 << 20:
                            yield _records_batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _records_batch(rows)

    cut = ranges(files, split)
    return cut.repartition(parts_for(files), "path", "start").mapInArrow(
        run, "path string, place long, type string, record_id string, refers_to string, url string, digest_hex string, http binary, payload binary")


def _records_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.binary(), pa.binary()]
    names = ["path", "place", "type", "record_id", "refers_to", "url", "digest_hex", "http", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _page(urn: str) -> Column:
    found = F.regexp_extract(F.coalesce(F.col(urn), F.lit("")), r"^<urn:page:(-?\d+)>$", 1)
    return F.when(found != "", found.cast("long"))


def page_rows(read: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of page records, digests in lower-case hex."""

    length = F.regexp_extract(F.decode("http", "UTF-8"), r"(?i)Content-Length:\s*(\d+)", 1).cast("long")
    return read.select(_page("record_id").alias("page_id"), length.alias("payload_bytes"), F.col("digest_hex").alias("payload_digest"),
                       F.col("type").alias("record_type"), _page("refers_to").alias("refers_to"))


def round_trip(spark: SparkSession, pages: DataFrame, split: int = SPLIT_BYTES) -> DataFrame:
    """Write `pages` as archives below the shared folder and read them back, one row per page.

    Null html is the empty payload, null urls are empty; pages without an id come back without one. An empty table writes
    no record and gives no row. Other columns are ignored.
    """
    return page_rows(read_records(write_pages(pages, scratch_path(spark, "warc")), split))

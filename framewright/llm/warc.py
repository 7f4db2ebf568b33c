"""WARC records packaged in ZIP archives, written and read by ranges.

An archive is a ZIP file of stored members: ``archive/data.warc.gz``, one gzip member
per record, and ``indexes/index.cdx``, one line of JSON per record with its offset and
length in that member. The reader parses the end records, the ZIP64 locator and
directory, finds the members without extracting them, and reads each record's range.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import arrow_batches, saved, scratch

#: Bytes and records after which a writer starts the next archive; bytes of one read and
#: records of one batch of a reader.
ARCHIVE_BYTES, ARCHIVE_RECORDS, READ_BYTES, READ_RECORDS = 128 << 20, 1 << 17, 4 << 20, 4096
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
DATE = "2024-01-01T00:00:00Z"
TAIL = 22 + 0xFFFF


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean(uri: str) -> str:
    """A header value: control characters and spaces are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in uri)


def page_name(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit without."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{page_name(page_id)}>"), ("WARC-Date", DATE), ("WARC-Target-URI", clean(url) if url else page_name(page_id)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def gzipped(data: bytes) -> bytes:
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def read_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of a record; header names in lower case."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(named["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    return named, fields, payload


@dataclass
class Member:
    name: str
    offset: int  # of its first data byte in the archive
    size: int
    stored: bool


class Archive:
    """A ZIP archive behind a random-access file; members are located, not extracted."""

    def __init__(self, file) -> None:
        self.file = file
        self.members = {m.name: m for m in self.directory()}

    def at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        data = self.file.read(size)
        if len(data) < size:
            raise ValueError("the archive ends early")
        return data

    def length(self) -> int:
        self.file.seek(0, 2)
        return self.file.tell()

    def directory(self) -> Iterator[Member]:
        length = self.length()
        tail = self.at(max(0, length - TAIL), min(length, TAIL))
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of central directory")
        entries, size, offset = struct.unpack_from("<H2L", tail, end + 10)
        place = length - len(tail) + end
        if place >= 20 and (locator := self.at(place - 20, 20))[:4] == b"PK\x06\x07":
            entries, size, offset = struct.unpack_from("<3Q", self.at(struct.unpack_from("<Q", locator, 8)[0], 56), 32)
        data, at = self.at(offset, size), 0
        for _ in range(entries):
            if data[at : at + 4] != b"PK\x01\x02":
                raise ValueError("a broken central directory")
            flags, method = struct.unpack_from("<2H", data, at + 8)
            packed, plain, names, extras, comments = struct.unpack_from("<2L3H", data, at + 20)
            local = struct.unpack_from("<L", data, at + 42)[0]
            name = data[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
            more = data[at + 46 + names : at + 46 + names + extras]
            plain, packed, local = zip64_fields(more, plain, packed, local)
            heads = struct.unpack_from("<2H", self.at(local, 30), 26)
            yield Member(name, local + 30 + sum(heads), packed, method == 0)
            at += 46 + names + extras + comments

    def read(self, name: str, offset: int = 0, size: int | None = None) -> bytes:
        """A range of a stored member."""
        member = self.members[name]
        if not member.stored:
            raise ValueError(f"{name} is compressed and has no ranges")
        size = member.size - offset if size is None else size
        if offset < 0 or offset + size > member.size:
            raise ValueError(f"a range beyond {name}")
        return self.at(member.offset + offset, size)

    def index(self) -> list[dict]:
        return [json.loads(line) for name in sorted(self.members) if name.startswith("indexes/") for line in self.read(name).decode().splitlines()]

    def record(self, line: dict) -> tuple[dict[str, str], dict[str, str], bytes]:
        return read_record(gzip.decompress(self.read(line["filename"], line["offset"], line["length"])))

    def records(self, most: int = READ_BYTES) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
        """All indexed records; neighbours are read in ranges of about ``most`` bytes."""
        lines = sorted(self.index(), key=lambda x: (x["filename"], x["offset"]))
        i = 0
        while i < len(lines):
            j, begin = i + 1, lines[i]["offset"]
            while j < len(lines) and lines[j]["filename"] == lines[i]["filename"] and lines[j]["offset"] + lines[j]["length"] - begin <= most:
                j += 1
            data = self.read(lines[i]["filename"], begin, lines[j - 1]["offset"] + lines[j - 1]["length"] - begin)
            for line in lines[i:j]:
                yield read_record(gzip.decompress(data[line["offset"] - begin : line["offset"] - begin + line["length"]]))
            i = j


def zip64_fields(extra: bytes, plain: int, packed: int, local: int) -> tuple[int, int, int]:
    """Sizes and offset, those that the ZIP64 extra field holds taken from there."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<2H", extra, at)
        if kind == 1:
            wide = iter(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            plain, packed, local = (next(wide) if x == 0xFFFFFFFF else x for x in (plain, packed, local))
        at += 4 + size
    return plain, packed, local


class Writer:
    """An archive that grows record by record."""

    def __init__(self, uri: str) -> None:
        self.out = files.writer(uri)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(DATA, "w", force_zip64=True)
        self.lines: list[str] = []
        self.size = 0

    def add(self, url: str, digest: str, data: bytes) -> None:
        packed = gzipped(data)
        self.member.write(packed)
        self.lines.append(json.dumps({"url": url, "timestamp": DATE, "digest": f"sha1:{digest}", "filename": DATA, "offset": self.size, "length": len(packed)}))
        self.size += len(packed)

    def close(self) -> int:
        self.member.close()
        self.zip.writestr(INDEX, "\n".join(self.lines))
        self.zip.close()
        self.out.close()
        return len(self.lines)


def archive_writer(folder: str, archive_bytes: int):
    """Write archives and yield a row for each: only those of a task that ended count."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = name = None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([out.close()], pa.int64())], ["path", "records"])

        for batch in batches:
            for page, url, html, sha1, size, first in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "sha1", "size", "response")), strict=True):
                if out is None:
                    name = f"{folder}/pages-{uuid.uuid4().hex}.zip"
                    out = Writer(name)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                out.add(url or page_name(page), digest, record(page, url, None if html is None else html.encode(), size, digest, first))
                if out.size >= archive_bytes or len(out.lines) >= ARCHIVE_RECORDS:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return write


def write_archives(pages: DataFrame, folder: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per page in archives in ``folder``; returns the saved list of them.

    Of pages with equal payloads of at least ``least`` bytes, that with the smallest id
    is the response and the others revisit it. A null payload is empty. Pages that share
    an id and a payload are written as often as they stand. A page with a null id has a
    record without a number: it revisits an equal page that has an id, and where none
    has, it is a response. Other columns are ignored; an empty table writes no archive.

    A revisit holds no payload, so copies are matched by digest and size alone and only
    responses carry their payload on, each found by its own id: the copies of one page
    never meet with their payloads in one task.
    """
    arrow_batches(pages.sparkSession)
    files.make_folder(folder)
    html = F.coalesce(html_col, F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).cast("long").alias("size"))
    firsts = rows.select("page_id", "sha1", "size").where(F.col("size") >= least).groupBy("sha1", "size").agg(F.min("page_id").alias("first"))
    known = [F.col("sha1") == F.col("sha1_"), F.col("size") == F.col("size_")]
    named = firsts.select("first", F.col("sha1").alias("sha1_"), F.col("size").alias("size_"))
    whole = rows.where(F.col("size") >= least).join(named, [*known, F.col("page_id").eqNullSafe(F.col("first"))], "left_semi")
    again = rows.where(F.col("size") >= least).select("page_id", "url", "sha1", "size").join(named, known).where(~F.col("page_id").eqNullSafe(F.col("first")))
    columns = ["page_id", "url", "html", "sha1", "size"]
    if least > 0:
        whole = whole.unionByName(rows.where(F.col("size") < least))
    responses = whole.select(*columns, F.lit(None).cast("long").alias("response"))
    records = responses.unionByName(again.select("page_id", "url", F.lit(None).cast("string").alias("html"), "sha1", "size", F.col("first").alias("response")))
    return saved(records.mapInArrow(archive_writer(folder, archive_bytes), "path string, records long"), "archives")


def read_archives(listed: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record,
    read from the archives by their indexes."""

    def number(uri: str) -> int | None:
        digits = uri.strip("<>").rpartition(":")[2]
        return int(digits) if digits else None

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                rows: list[tuple] = []
                with files.reader(path) as file:
                    for named, http, payload in Archive(file).records():
                        kind = named["warc-type"]
                        digest = named["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and payload_digest(payload) != digest:
                            raise ValueError(f"a damaged payload in {path}")
                        rows.append((number(named["warc-record-id"]), int(http["content-length"]), digest, kind, number(named["warc-refers-to"]) if kind == "revisit" else None))
                        if len(rows) >= READ_RECORDS:
                            yield told(rows)
                            rows = []
                if rows:
                    yield told(rows)

    tasks = max(1, int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return listed.repartition(tasks, "path").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write archives in the shared folder and read every record back."""
    return read_archives(write_archives(pages, scratch(pages.sparkSession, "warc"), least))


#: DuckDB has sha1 in hexadecimal; base32 is spelled from the bits of 5 at a time.
ORACLE_SQL = """
WITH pages_ AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT h, min(page_id) AS response FROM pages_ GROUP BY h)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 4), lambda q: list_aggregate(list_transform(range(0, 8), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + q * 10, 10))::BIGINT >> (35 - 5 * i)) & 31)::INT, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM response THEN response END AS refers_to
FROM pages_ JOIN firsts USING (h)
"""

"""WARC records in ZIP-packaged archives, and a reader that range-reads them in place.

An archive is a ZIP file whose members are stored, not compressed: the WARC records (each a
gzip member of its own), a CDXJ index of their offsets and a package description. The reader
finds the end of the central directory, follows the ZIP64 locator where there is one, parses
the directory, and turns each member into a byte range of the archive; index lines then give
the byte range of each record. No member is extracted: only the directory, the index and the
records themselves are read.

Tasks write archives of bounded size straight to the shared folder. A name is new for each
attempt, and only archives that a committed manifest lists are read, so retried or speculative
tasks leave at most unread files. Reading is spread over ranges of archives, not whole ones.

Defined cases: a NULL payload is empty; of rows with equal payloads of at least ``least``
bytes, the one with the largest page_id is the response and the others revisit it (a row that
repeats this page_id is a response as well); where all are NULL, so all are responses; a NULL
page_id or url is left out of its record; an empty table gives no archive and no row; further
columns do not matter.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.llm.tables import area, column, table

#: A task starts another archive after this many payload bytes or records.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 64 << 20, 50_000
#: Records are read in tasks of about this much of an archive, and in reads of at most this much.
RANGE_BYTES, READ_BYTES = 16 << 20, 4 << 20
#: Payloads below this many bytes are never revisits.
LEAST_PAYLOAD = 0
DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:x-page:"

ReadAt = Callable[[int, int], bytes]


class Member(NamedTuple):
    name: str
    method: int
    size: int
    header: int  # where its local header is


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a URI and the path in it; a plain path is local."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


# ---------------------------------------------------------------- ZIP directories


def _zip64_values(extra: bytes, wanted: list[bool]) -> list[int]:
    """The 64-bit values of the ZIP64 extra field: one for each field that overflowed."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            return list(struct.unpack_from(f"<{sum(wanted)}Q", extra, at + 4))
        at += 4 + size
    raise ValueError("a ZIP64 member has no ZIP64 field")


def read_directory(read_at: ReadAt, size: int) -> list[Member]:
    """All members of an archive of ``size`` bytes, from its central directory."""
    tail_start = max(0, size - 65_557)  # the longest comment and the end record
    tail = read_at(tail_start, size - tail_start)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        locator_at = tail_start + end - 20
        locator = read_at(locator_at, 20) if locator_at >= 0 else b""
        if locator[:4] == b"PK\x06\x07":
            record = read_at(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("the ZIP64 locator points to no ZIP64 record")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
    directory = read_at(start, length)
    members, at = [], 0
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n_name]
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        over = [v == 0xFFFFFFFF for v in (plain, packed, header)]
        if any(over):
            wide = iter(_zip64_values(extra, over))
            plain, packed, header = (
                next(wide) if o else v for o, v in zip(over, (plain, packed, header), strict=True)
            )
        text = name.decode("utf-8" if flags & 0x800 else "cp437")
        members.append(Member(text, method, packed, header))
        at += 46 + n_name + n_extra + n_comment
    return members


def member_start(read_at: ReadAt, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method != zipfile.ZIP_STORED:
        raise ValueError(f"{member.name} is compressed; only stored members can be range-read")
    header = read_at(member.header, 30)
    if header[:4] != b"PK\x03\x04":
        raise ValueError(f"{member.name} has no local header")
    n_name, n_extra = struct.unpack_from("<HH", header, 26)
    return member.header + 30 + n_name + n_extra


# ---------------------------------------------------------------- records


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page: str | None) -> str:
    return f"<{_URN}{'' if page is None else quote(page, safe='')}>"


def record(
    page: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool
) -> bytes:
    """One WARC record as a gzip member; a revisit holds the HTTP header without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}")
    if revisit:
        lines += [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head = "\r\n".join(lines) + "\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", compresslevel=3, mtime=0)


class Record(NamedTuple):
    page: str | None
    url: str | None
    kind: str
    refers_to: str | None
    digest: str
    payload_bytes: int
    payload: bytes


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in head.decode().split("\r\n")[1:] if ":" in line)
    return {name.lower(): value.strip() for name, value in pairs}


def _page_of(urn: str | None) -> str | None:
    from urllib.parse import unquote

    return unquote(urn[len(_URN) + 1 : -1]) or None if urn else None


def parse_record(member: bytes) -> Record:
    """The record of one gzip member; a payload must have the digest that its header states."""
    data = zlib.decompress(member, wbits=31)
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and payload_digest(payload) != digest:
        raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
    return Record(
        _page_of(fields["warc-record-id"]),
        fields.get("warc-target-uri"),
        kind,
        _page_of(fields.get("warc-refers-to")),
        digest,
        int(_fields(http)["content-length"]),
        payload,
    )


# ---------------------------------------------------------------- writing


class _Append(io.RawIOBase):
    """What a ZIP writer needs of an object store: bytes in order, no seeking back."""

    def __init__(self, stream) -> None:
        self._stream = stream

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self._stream.write(bytes(data))
        return len(data)


class ArchiveWriter:
    """One archive: records go to the data member as they come, the index follows."""

    def __init__(self, folder: str) -> None:
        store, path = filesystem(folder)
        store.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.wacz"
        self.uri = f"{folder}/{name}"
        self._stream = store.open_output_stream(f"{path}/{name}")
        self._zip = zipfile.ZipFile(_Append(self._stream), "w", zipfile.ZIP_STORED)
        self._data = self._zip.open(DATA, "w", force_zip64=True)
        self._lines: list[str] = []
        self._offset = self.payload_bytes = 0

    @property
    def records(self) -> int:
        return len(self._lines)

    def add(self, url: str | None, member: bytes, payload_bytes: int) -> None:
        self._data.write(member)
        place = {"offset": self._offset, "length": len(member), "filename": DATA, "url": url or ""}
        self._lines.append(json.dumps(place, ensure_ascii=True))
        self._offset += len(member)
        self.payload_bytes += payload_bytes

    def close(self) -> None:
        self._data.close()
        index = "".join(f"- 19700101000000 {line}\n" for line in self._lines)
        self._zip.writestr(INDEX, index)
        about = {"profile": "data-package", "wacz_version": "1.1.1", "resources": [DATA, INDEX]}
        self._zip.writestr(PACKAGE, json.dumps(about))
        self._zip.close()
        self._stream.close()


def write_archives(
    spark: SparkSession, pages: DataFrame, folder: str, least: int = LEAST_PAYLOAD
) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) and returns the manifest: archive, bytes, records."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, made = None, []

        def finish() -> None:
            archive.close()
            store, path = filesystem(archive.uri)
            made.append((archive.uri, store.get_file_info(path).size, archive.records))

        for batch in batches:
            columns = [batch.column(n) for n in ("page", "url", "payload", "refers_to", "revisit")]
            for values in zip(*columns, strict=True):
                page, url, payload, refers_to, revisit = (v.as_py() for v in values)
                archive = archive or ArchiveWriter(folder)
                member = record(page, url, payload, refers_to, revisit)
                archive.add(url, member, len(payload))
                if archive.payload_bytes >= ARCHIVE_BYTES or archive.records >= ARCHIVE_RECORDS:
                    finish()
                    archive = None
        if archive:
            finish()
        if made:
            names = ["archive", "bytes", "records"]
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*made)), strict=True)))

    payload = F.coalesce(column("html").cast("string"), F.lit(""))
    told = pages.select(
        column("page_id").alias("id"),
        column("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.unhex(F.sha2(payload, 256)).alias("digest"),
    )
    firsts = (
        told.where(F.octet_length("payload") >= least)
        .groupBy("digest")
        .agg(F.max("id").alias("first"))
    )
    # Written, so that the pages of a payload that many share are split over tasks.
    rows = told.join(area(spark).put("firsts", firsts), "digest", "left").select(
        F.col("id").cast("string").alias("page"),
        "url",
        F.encode("payload", "UTF-8").alias("payload"),
        F.col("first").cast("string").alias("refers_to"),
        (F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))).alias("revisit"),
    )
    manifest = rows.mapInArrow(write, "archive string, bytes long, records long")
    return area(spark).put("manifest", manifest)


# ---------------------------------------------------------------- reading


def _opened(uri: str) -> tuple[ReadAt, int]:
    store, path = filesystem(uri)
    source = store.open_input_file(path)

    def read_at(offset: int, size: int) -> bytes:
        data = source.read_at(size, offset)
        if len(data) != size:
            raise ValueError(f"{uri} ends before byte {offset + size}")
        return data

    return read_at, source.size()


def index_archive(uri: str) -> Iterator[tuple[int, int]]:
    """The byte ranges (offset in the archive, length) of the records that its indexes list."""
    read_at, size = _opened(uri)
    members = {m.name: m for m in read_directory(read_at, size)}
    starts: dict[str, int] = {}
    for name, member in members.items():
        if not (name.startswith("indexes/") and name.endswith(".cdxj")):
            continue
        text = read_at(member_start(read_at, member), member.size)
        for line in text.splitlines():
            place = json.loads(line.split(b" ", 2)[2])
            holder = place["filename"]
            if holder not in starts:
                starts[holder] = member_start(read_at, members[holder])
            yield starts[holder] + place["offset"], place["length"]


def _record_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column("archive").to_pylist():
            places = list(index_archive(uri))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([uri] * len(places), pa.string()),
                    pa.array([a for a, _ in places], pa.int64()),
                    pa.array([n for _, n in places], pa.int64()),
                ],
                names=["archive", "offset", "length"],
            )


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads neighbouring records together; rows come in order of archive and offset."""
    uri = read_at = None
    for batch in batches:
        rows = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        found, at = [], 0
        while at < len(rows):
            if rows[at][0] != uri:
                uri = rows[at][0]
                read_at = _opened(uri)[0]
            start, stop, upto = rows[at][1], rows[at][1] + rows[at][2], at + 1
            while (
                upto < len(rows)
                and rows[upto][:2] == (uri, stop)
                and stop + rows[upto][2] - start <= READ_BYTES
            ):
                stop += rows[upto][2]
                upto += 1
            data = read_at(start, stop - start)
            for _, offset, length in rows[at:upto]:
                found.append(parse_record(data[offset - start : offset - start + length]))
            at = upto
        columns = zip(*found, strict=True) if found else [()] * len(Record._fields)
        types = [pa.string()] * 5 + [pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)],
            names=list(Record._fields),
        )


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of the archives (a manifest: archive, bytes): its fields and its payload."""
    # One archive per task at most; the number of tasks follows the number of archives.
    listed = archives.select("archive").hint("rebalance", "archive")
    places = listed.mapInArrow(_record_places, "archive string, offset long, length long")
    # As many tasks as ranges: places are small rows, whose size tells nothing of the records.
    n_ranges = archives.agg(F.sum(F.floor(F.col("bytes") / F.lit(RANGE_BYTES)) + 1)).first()[0]
    ranges = places.repartition(
        n_ranges or 1, F.col("archive"), F.floor(F.col("offset") / F.lit(RANGE_BYTES))
    ).sortWithinPartitions("archive", "offset")
    return ranges.mapInArrow(
        _records,
        "page string, url string, kind string, refers_to string, digest string,"
        " payload_bytes long, payload binary",
    )


def op1_wacz(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    manifest = write_archives(spark, pages, f"{area(spark).path}/archives")
    id_type = pages.schema["page_id"].dataType
    return read_archives(manifest).select(
        F.col("page").cast(id_type).alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.when(F.col("kind") == "revisit", F.col("refers_to").cast(id_type)).alias("refers_to"),
    )


# Base 32 by arithmetic: each five hex digits of the SHA-1 are four characters.
OP1_SQL = """
WITH told AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
firsts AS (SELECT payload, max(page_id) AS first_id FROM told GROUP BY payload)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
       list_aggregate([
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::INTEGER >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)
         FOR i IN range(32)], 'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id OR first_id IS NULL
            THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM told JOIN firsts USING (payload)
"""

"""WARC records in ZIP-packaged archives: writing, and reading by byte range without unpacking.

An archive is a ZIP file whose members are stored as they are: `archive/data.warc.gz` (every record a gzip member of its
own) and `indexes/index.cdxj` (one line per record with its offset and length). A reader takes the directory at the end
of the ZIP (with its ZIP64 form), finds where the members' bytes begin, and reads the index and then single records by
their place in the file.

Equal payloads are written once: the record with the largest page id keeps the payload, the others refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zipfile
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.files import new_file, open_ranges

WARC_MEMBER = "archive/data.warc.gz"
INDEX_MEMBER = "indexes/index.cdxj"
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
# Fixed value: the profile of the public standard for a record that repeats a payload.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "part INT, archive INT, path STRING, records BIGINT"


# Records -----------------------------------------------------------------------------------------


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    number = name.strip("<>").rpartition(":")[2]
    return None if number == "null" else int(number)


def make_record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One record; of a revisit only the HTTP head is kept, with the length and digest of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {''.join((url or 'about:blank').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {SAME_PAYLOAD}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    page_id: int | None
    url: str
    record_type: str
    refers_to: int | None
    payload: bytes | None  # none of a revisit
    payload_bytes: int
    payload_digest: str


def _heads(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}, body


def parse_record(raw: bytes) -> Record:
    if not raw.startswith(b"WARC/1."):
        raise ValueError("no WARC record here")
    heads, rest = _heads(raw)
    http, payload = _heads(rest[: int(heads["content-length"])])
    kept = heads["warc-type"] == "response"
    size, stated = int(http["content-length"]), heads["warc-payload-digest"].removeprefix("sha1:")
    if kept and (len(payload) != size or digest_of(payload) != stated):
        raise ValueError(f"payload of {heads['warc-record-id']} is damaged")
    return Record(
        _page(heads["warc-record-id"]), heads["warc-target-uri"], heads["warc-type"],
        None if kept else _page(heads["warc-refers-to"]), payload if kept else None, size, stated,
    )


# The ZIP directory -------------------------------------------------------------------------------

# Signatures and fixed lengths of the public ZIP format.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
END_SIZE, LOCATOR_SIZE, END64_SIZE, ENTRY_SIZE, LOCAL_SIZE = 22, 20, 56, 46, 30
LONGEST_COMMENT = 65_535
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


@dataclass
class Member:
    name: str
    method: int
    size: int  # stored bytes
    header: int  # where its local header begins


def read_directory(file) -> dict[str, Member]:
    """The members of a ZIP file from its central directory, which may be of the ZIP64 form."""
    length = file.size()
    tail_at = max(0, length - END_SIZE - LONGEST_COMMENT - LOCATOR_SIZE)
    tail = file.read_at(length - tail_at, tail_at)
    at = tail.rfind(END)
    while at >= 0 and at + END_SIZE + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
        at = tail.rfind(END, 0, at)  # the signature stood inside the comment
    if at < 0:
        raise ValueError("no ZIP directory")
    count, size, begin = struct.unpack("<HII", tail[at + 10 : at + 20])
    if FULL16 == count or FULL32 in (size, begin):
        locator = tail[at - LOCATOR_SIZE : at]
        if locator[:4] != LOCATOR64:
            raise ValueError("the ZIP64 directory is missing")
        end64 = file.read_at(END64_SIZE, struct.unpack("<Q", locator[8:16])[0])
        if end64[:4] != END64:
            raise ValueError("the ZIP64 directory is damaged")
        count, size, begin = struct.unpack("<QQQ", end64[32:56])
    raw, members, at = file.read_at(size, begin), {}, 0
    for _ in range(count):
        if raw[at : at + 4] != ENTRY:
            raise ValueError("the ZIP directory is damaged")
        method, = struct.unpack("<H", raw[at + 10 : at + 12])
        packed, full, n_name, n_extra, n_comment = struct.unpack("<IIHHH", raw[at + 20 : at + 34])
        header, = struct.unpack("<I", raw[at + 42 : at + 46])
        name_at = at + ENTRY_SIZE
        name = raw[name_at : name_at + n_name].decode()
        extra = raw[name_at + n_name : name_at + n_name + n_extra]
        while len(extra) >= 4:
            kind, room = struct.unpack("<HH", extra[:4])
            if kind == 1:  # the wide fields, present in this order where the narrow one is full
                wide = iter(struct.unpack(f"<{room // 8}Q", extra[4 : 4 + room // 8 * 8]))
                full = next(wide) if full == FULL32 else full
                packed = next(wide) if packed == FULL32 else packed
                header = next(wide) if header == FULL32 else header
            extra = extra[4 + room :]
        members[name] = Member(name, method, packed, header)
        at = name_at + n_name + n_extra + n_comment
    return members


def member_start(file, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed: its records have no place in the file")
    head = file.read_at(LOCAL_SIZE, member.header)
    if head[:4] != LOCAL:
        raise ValueError(f"{member.name} has no local header")
    n_name, n_extra = struct.unpack("<HH", head[26:30])
    return member.header + LOCAL_SIZE + n_name + n_extra


class ArchiveReader:
    """Records of one open archive by their index entries."""

    def __init__(self, file):
        self.file = file
        members = read_directory(file)
        self.data_at = member_start(file, members[WARC_MEMBER])
        self.data_size = members[WARC_MEMBER].size
        index = members[INDEX_MEMBER]
        text = file.read_at(index.size, member_start(file, index)).decode()
        self.lines = text.split("\n")[:-1]

    def entries(self) -> list[tuple[int, int]]:
        """(offset, length) of every record, in file order."""
        return sorted((e["offset"], e["length"]) for e in (json.loads(line.split(" ", 2)[2]) for line in self.lines))

    def find(self, page_id: int | None) -> list[Record]:
        """The records of one page, by binary search in the sorted index."""
        key = _index_key(page_id)
        at, found = bisect_left(self.lines, key), []
        while at < len(self.lines) and self.lines[at].startswith(key):
            entry = json.loads(self.lines[at].split(" ", 2)[2])
            raw = self.file.read_at(entry["length"], self.data_at + entry["offset"])
            found.append(parse_record(zlib.decompress(raw, 31)))
            at += 1
        return found

    def records(self) -> Iterator[Record]:
        """All records; neighbours are read together in ranges of bounded length."""
        entries = self.entries()
        first = 0
        while first < len(entries):
            begin, last = entries[first][0], first
            while last + 1 < len(entries) and sum(entries[last + 1]) - begin <= READ_BYTES:
                last += 1
            raw = memoryview(self.file.read_at(sum(entries[last]) - begin, self.data_at + begin))
            for offset, length in entries[first : last + 1]:
                yield parse_record(zlib.decompress(raw[offset - begin : offset - begin + length], 31))
            first = last + 1


def _index_key(page_id: int | None) -> str:
    return "page:null " if page_id is None else f"page:{page_id + (1 << 63):020d} "


# Spark -------------------------------------------------------------------------------------------


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """page_id, url, html, digest (hex), payload_bytes, refers_to and revisit of every page.

    Payloads of at least `least` bytes that are equal are one group. The largest page id is found by a partial
    aggregation; the join back to the pages splits a payload that many pages share.
    """
    rows = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"),
        F.col(url).alias("url"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("html"),
    )
    rows = rows.withColumns({"sha1": F.sha1("html"), "payload_bytes": F.octet_length("html").cast("bigint")})
    shared = rows.filter(F.col("payload_bytes") >= least)
    groups = shared.groupBy(F.col("sha1").alias("of"), F.col("payload_bytes").alias("size")).agg(F.max("page_id").alias("keeper"))
    joined = rows.join(groups, (F.col("sha1") == F.col("of")) & (F.col("payload_bytes") == F.col("size")), "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.select(
        "page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "sha1", "payload_bytes",
        F.when(revisit, F.col("keeper")).alias("refers_to"), revisit.alias("revisit"),
    )


def write_archives(planned: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """Write every planned record into archives of about `archive_bytes` and return their manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        rows = (row for batch in batches for row in batch.to_pylist())
        row = next(rows, None)
        while row is not None:
            path = f"{folder}/part-{part:06d}-{number:04d}.wacz"
            lines, at = [], 0
            with new_file(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
                with package.open(zipfile.ZipInfo(WARC_MEMBER), "w", force_zip64=True) as member:
                    while row is not None and (at < archive_bytes or not lines):
                        digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                        raw = make_record(
                            row["page_id"], row["url"], row["html"] or b"", row["payload_bytes"], digest,
                            row["refers_to"], row["revisit"], date,
                        )
                        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                        packed = packer.compress(raw) + packer.flush()
                        member.write(packed)
                        place = json.dumps({"offset": at, "length": len(packed), "digest": f"sha1:{digest}"})
                        lines.append(f"{_index_key(row['page_id'])}{date} {place}\n")
                        at += len(packed)
                        row = next(rows, None)
                lines.sort()
                package.writestr(zipfile.ZipInfo(INDEX_MEMBER), "".join(lines))
                package.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "records": len(lines)}))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([path]), pa.array([len(lines)])],
                names=["part", "archive", "path", "records"],
            )
            number += 1

    manifest = f"{folder}/manifest"
    planned.mapInArrow(write, MANIFEST).write.parquet(manifest)
    return planned.sparkSession.read.schema(MANIFEST).parquet(manifest)


RECORD = (
    "page_id BIGINT, url STRING, payload_bytes BIGINT, payload_digest STRING, record_type STRING, refers_to BIGINT, payload BINARY"
)


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the archives, one archive per task; a damaged payload raises."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (path for batch in batches for path in batch.column(0).to_pylist()):
            with open_ranges(path) as file:
                held: list[Record] = []
                size = 0
                for record in ArchiveReader(file).records():
                    held.append(record)
                    size += len(record.payload or b"") + 256
                    if size > READ_BYTES:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    archives = max(1, manifest.count())
    return manifest.select("path").repartitionByRange(archives, "path").mapInArrow(read, RECORD)


def _batch(records: list[Record]) -> pa.RecordBatch:
    kinds = {
        "page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
        "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary(),
    }
    return pa.RecordBatch.from_arrays([pa.array([getattr(r, n) for r in records], k) for n, k in kinds.items()], names=list(kinds))


def archive_pages(pages: DataFrame, folder: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES, **columns: str) -> DataFrame:
    """Write one record per page below `folder` and return the archives' manifest.

    A null html is an empty payload; a null url becomes `about:blank`; a null page id is kept and never the one that
    others refer to unless it is alone. Pages equal in id and payload are all of the same type. An empty table writes
    no archive. Columns other than the three are not archived.
    """
    return write_archives(plan_records(pages, least=least, **columns), folder, archive_bytes)

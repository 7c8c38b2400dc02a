"""WARC records in ZIP packages, read back by ranges.

A package is a ZIP file with two stored (uncompressed) members: `archive/data.warc.gz`, whose records are gzip members of
their own, and `indexes/index.cdxj`, a line per record with its offset and length. The reader asks its source for
ranges only: the end record, the ZIP64 end record where there is one, the central directory, a member's local
header, the index, and then each record. Nothing is extracted. A source is any `read_at(offset, size)` with a size, so
packages may be files of any store or, as here, rows of a Parquet table in the shared folder.

Of records with equal payloads the one with the least page_id is a response, the others revisit it.

Defined cases
* null html: empty payload; null url: no target URI. Line breaks in a url are percent-encoded.
* rows that repeat a page_id: with the payload of the response they are responses too; rows without an id are responses.
* payloads under `min_bytes`: always responses. Empty table: no packages, no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, ship, table, written

#: Bytes of records at which a package is closed.
PACKAGE_BYTES = 8_000_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Pages carry no time, so records carry this one.
DATE = "2000-01-01T00:00:00Z"
_MAX16, _MAX32 = 0xFFFF, 0xFFFFFFFF


class Source:
    """Ranges of a bytes-like object."""

    def __init__(self, data):
        self.data, self.size = memoryview(data), len(data)

    def read_at(self, offset: int, size: int) -> bytes:
        return bytes(self.data[offset : offset + size])


class FileSource:
    """Ranges of an open seekable file."""

    def __init__(self, file):
        self.file = file
        self.size = file.seek(0, 2)

    def read_at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)


def write_zip(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """Stored members; with ZIP64 records where sizes or numbers call for them, or always on request."""
    out, directory = bytearray(), bytearray()
    for name, data in members:
        raw, crc, at = name.encode(), zlib.crc32(data), len(out)
        big = zip64 or len(data) >= _MAX32 or at >= _MAX32
        n = _MAX32 if big else len(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        out += struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if big else 20, 0x800, 0, 0, 0x21, crc, n, n, len(raw), len(extra)) + raw + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if big else b""
        directory += struct.pack(
            "<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45 if big else 20, 0x800, 0, 0, 0x21, crc, n, n, len(raw), len(extra), 0, 0, 0, 0, _MAX32 if big else at
        ) + raw + extra
    at = len(out)
    out += directory
    count = len(members)
    if zip64 or at >= _MAX32 or count >= _MAX16:
        end = len(out)
        out += struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, count, count, len(directory), at)
        out += struct.pack("<IIQI", 0x07064B50, 0, end, 1)
        count, length, at = _MAX16, _MAX32, _MAX32
    else:
        length = len(directory)
    return bytes(out + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, count, count, length, at, 0))


class ZipReader:
    """Central directory of a package; members are read by ranges."""

    def __init__(self, source):
        self.source = source
        tail_at = max(0, source.size - 22 - _MAX16)
        tail = source.read_at(tail_at, source.size - tail_at)
        k = tail.rfind(b"PK\x05\x06")
        while k >= 0 and (k + 22 > len(tail) or k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != len(tail)):
            k = tail.rfind(b"PK\x05\x06", 0, k)
        if k < 0:
            raise ValueError("no end of central directory")
        count, length, at = struct.unpack_from("<HII", tail, k + 10)
        if _MAX16 == count or _MAX32 in (length, at):
            locator = source.read_at(tail_at + k - 20, 20)
            if locator[:4] == b"PK\x06\x07":
                end = source.read_at(struct.unpack_from("<Q", locator, 8)[0], 56)
                if end[:4] != b"PK\x06\x06":
                    raise ValueError("no ZIP64 end of central directory")
                count, length, at = struct.unpack_from("<QQQ", end, 32)
        self.members: dict[str, tuple[int, int, int, int]] = {}  # name -> method, stored size, size, header offset
        directory, k = source.read_at(at, length), 0
        for _ in range(count):
            if directory[k : k + 4] != b"PK\x01\x02":
                raise ValueError("damaged central directory")
            method = struct.unpack_from("<H", directory, k + 10)[0]
            stored, size, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, k + 20)
            header = struct.unpack_from("<I", directory, k + 42)[0]
            name = directory[k + 46 : k + 46 + n_name].decode()
            extra, j = directory[k + 46 + n_name : k + 46 + n_name + n_extra], 0
            while j + 4 <= len(extra):
                kind, n = struct.unpack_from("<HH", extra, j)
                if kind == 1:  # holds only the fields that overflowed, in this order
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, j + 4))
                    size = next(wide) if size == _MAX32 else size
                    stored = next(wide) if stored == _MAX32 else stored
                    header = next(wide) if header == _MAX32 else header
                j += 4 + n
            self.members[name] = (method, stored, size, header)
            k += 46 + n_name + n_extra + n_comment

    def range_of(self, name: str) -> tuple[int, int]:
        """Place of a stored member's bytes in the package."""
        method, stored, _, header = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed and can't be read by ranges")
        local = self.source.read_at(header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("no local header")
        n_name, n_extra = struct.unpack_from("<HH", local, 26)
        return header + 30 + n_name + n_extra, stored

    def read_range(self, name: str, offset: int, size: int) -> bytes:
        at, stored = self.range_of(name)
        if offset < 0 or offset + size > stored:
            raise ValueError("range outside the member")
        return self.source.read_at(at + offset, size)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A"))] if url is not None else []),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        *([("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC fields, HTTP head, payload)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def write_packages(pages: DataFrame, min_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """One row per package: archive (its name), zip. Which package a record is in doesn't matter, so every task packs the rows it has,
    as many packages as they take; no key gathers rows."""
    ship(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    pages = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.sha1(html).alias("sha"))
    long_enough = pages.filter(F.octet_length("html") >= min_bytes)
    first = long_enough.groupBy("sha").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).filter("n > 1 and least is not null")
    # a table of its own, so that the join, the one shuffle of payloads, is free to split hot ones
    first = written(first.select("sha", "least"), "least-pages")
    rows = pages.join(first.hint("merge"), "sha", "left").select("page_id", "url", "html", "least")

    def package(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        data, index, made = bytearray(), [], 0

        def closed():
            nonlocal data, index, made
            packed = write_zip([(DATA, bytes(data)), (INDEX, "\n".join(index).encode())])
            name = f"{TaskContext.get().partitionId():06d}-{made:06d}.wacz"
            data, index, made = bytearray(), [], made + 1
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([packed], pa.binary())], names=["archive", "zip"])

        for b in batches:
            for page_id, url, text, least in zip(*(c.to_pylist() for c in b.columns)):
                payload = text.encode("utf-8", "surrogatepass")
                refers_to = least if page_id is not None and page_id != least and len(payload) >= min_bytes else None
                record = gzip.compress(_record(page_id, url, payload, digest_of(payload), refers_to), 2, mtime=0)
                index.append(json.dumps({"page_id": page_id, "offset": len(data), "length": len(record)}))
                data += record
                if len(data) >= package_bytes:
                    yield closed()
        if index:
            yield closed()

    return rows.mapInArrow(package, "archive string, zip binary")


def read_packages(packages: DataFrame) -> DataFrame:
    """One row per record of every package, by range reads; responses are verified against their digest."""

    def make():
        def run(archive, data):
            reader = ZipReader(Source(data))
            index = reader.read_range(INDEX, 0, reader.members[INDEX][2])
            at, stored = reader.range_of(DATA)
            for line in index.decode().splitlines():
                entry = json.loads(line)
                if entry["offset"] + entry["length"] > stored:
                    raise ValueError("an index entry lies outside its member")
                fields, http, payload = parse_record(gzip.decompress(reader.source.read_at(at + entry["offset"], entry["length"])))
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                size = int(http.rpartition(b"Content-Length: ")[2])
                refers_to = fields.get("WARC-Refers-To")
                if refers_to is None and (len(payload) != size or digest_of(payload) != digest):
                    raise ValueError("a payload doesn't match its digest")
                page_id = fields["WARC-Record-ID"][len("<urn:page:") : -1]
                yield (
                    int(page_id) if page_id else None,
                    size,
                    digest,
                    fields["WARC-Type"],
                    int(refers_to[len("<urn:page:") : -1]) if refers_to else None,
                )

        return run

    return map_rows(packages.select("archive", "zip"), make, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_packages(written(write_packages(table(spark, sf_dir, "pages")), "packages"))

"""WARC records in ZIP-packaged archives, and a reader that needs no extraction.

An archive is a ZIP file with the stored members `archive/data.warc.gz` (each record a gzip member of its own) and
`indexes/index.cdxj` (one line a record: its offset and length in the WARC member). The reader takes the end of central directory
record, or its ZIP64 form, from the file's tail, then the central directory, then the local header of a stored member, and
range-reads the index and single records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, open_fs, read

WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
LEAST_BYTES = 0


def b32(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


# ---- ZIP -------------------------------------------------------------------------------------------------------------


@dataclass
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int
    crc: int


class ZipReader:
    """Members of a ZIP file over a seekable file with read(n), read by ranges only."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        tail_at = max(0, size - 22 - 65535 - 20)
        tail = self.range(tail_at, size - tail_at)
        at = tail.rfind(b"PK\5\6")
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(b"PK\5\6", 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        _, _, _, count, length, start, _ = struct.unpack_from("<HHHHIIH", tail, at + 4)
        if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
            locator = tail[at - 20 : at]
            if locator[:4] != b"PK\6\7":
                raise ValueError("no ZIP64 locator")
            record = self.range(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
        self.members: dict[str, Member] = {}
        central, p = self.range(start, length), 0
        for _ in range(count):
            if central[p : p + 4] != b"PK\1\2":
                raise ValueError("broken central directory")
            flags, method, _, crc, packed, plain, n, extra, comment = struct.unpack_from("<HHIIIIHHH", central, p + 8)
            header = struct.unpack_from("<I", central, p + 42)[0]
            name = central[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            x, q = central[p + 46 + n : p + 46 + n + extra], 0
            while q + 4 <= len(x):
                kind, m = struct.unpack_from("<HH", x, q)
                if kind == 1:
                    big = iter(struct.unpack_from(f"<{m // 8}Q", x, q + 4))
                    plain, packed, header = (next(big) if v == 0xFFFFFFFF else v for v in (plain, packed, header))
                q += 4 + m
            self.members[name] = Member(name, method, plain, packed, header, crc)
            p += 46 + n + extra + comment

    def range(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def data_at(self, name: str) -> tuple[int, int]:
        """Offset and bytes of a stored member's data."""
        m = self.members[name]
        if m.method:
            raise ValueError(f"{name} is compressed; only stored members can be range-read")
        head = self.range(m.header, 30)
        if head[:4] != b"PK\3\4":
            raise ValueError("no local header")
        n, extra = struct.unpack_from("<HH", head, 26)
        return m.header + 30 + n + extra, m.packed

    def read(self, name: str, at: int = 0, n: int | None = None) -> bytes:
        start, size = self.data_at(name)
        return self.range(start + at, min(n if n is not None else size, size - at))


class ZipWriter:
    """Stored members written in one pass to a stream; ZIP64 fields throughout, sizes in a data descriptor after the data."""

    def __init__(self, stream):
        self.out, self.at, self.central = stream, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.header, self.crc = name.encode(), self.at, 0
        # flag 8: sizes follow the data; the empty ZIP64 field makes them 8 bytes each
        self._put(struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0x808, 0, 0, 0x21, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(self.name), 20) + self.name + struct.pack("<HHQQ", 1, 16, 0, 0))
        self.start = self.at

    @property
    def size(self) -> int:
        """Bytes of the open member so far."""
        return self.at - self.start

    def write(self, data: bytes) -> None:
        self.crc = zlib.crc32(data, self.crc)
        self._put(data)

    def end(self) -> None:
        n = self.size
        self._put(struct.pack("<4sIQQ", b"PK\7\x08", self.crc, n, n))
        self.central.append(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0x808, 0, 0, 0x21, self.crc, 0xFFFFFFFF, 0xFFFFFFFF, len(self.name), 28, 0, 0, 0, 0, 0xFFFFFFFF) + self.name + struct.pack("<HHQQQ", 1, 24, n, n, self.header))

    def member(self, name: str, data: bytes) -> None:
        self.begin(name)
        self.write(data)
        self.end()

    def close(self) -> None:
        start, body = self.at, b"".join(self.central)
        self._put(body)
        end, n = self.at, len(self.central)
        self._put(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, len(body), start))
        self._put(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
        self._put(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))


# ---- records ---------------------------------------------------------------------------------------------------------


def _clean(v: str | None) -> str:
    return (v or "").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head of the payload it stands for and no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {_clean(url)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gz(data: bytes) -> bytes:
    c = zlib.compressobj(3, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def parse(raw: bytes) -> dict:
    """The fields of one record: headers by lower-case name, http headers, body."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    fields["http"] = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    fields["body"] = body
    return fields


def _urn(v: str | None) -> int | None:
    x = (v or "").removeprefix("<urn:page:").removesuffix(">")
    return int(x) if x else None


def plan(pages: DataFrame, least_bytes: int, scratch: Scratch) -> DataFrame:
    """pages with refers_to: the largest page_id of an equal payload, null for that one itself and for payloads below least_bytes.

    Equal payloads are found by SHA-256 and length. Rows that share the largest page_id are all responses; null ids count lowest.
    """
    digest = F.sha2(F.coalesce(F.col("html").cast("binary"), F.lit(b"")), 256)
    size = F.octet_length(F.coalesce("html", F.lit("")))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", digest.alias("key"), size.alias("size"))
    groups = keyed.where(size >= least_bytes).groupBy("key").agg(F.max("page_id").alias("top"), F.count("*").alias("m")).where("m > 1")
    groups = scratch.save(groups.select(F.col("key").alias("k"), "top"), "groups")
    if not groups.limit(1).count():
        return keyed.select("page_id", "url", "html", F.lit(None).cast("long").alias("top"), F.lit(False).alias("revisit"))
    out = keyed.join(groups, F.expr("key = k"), "left")
    return out.select("page_id", "url", "html", "top", F.expr(f"k is not null and size >= {least_bytes} and not (page_id <=> top)").alias("revisit"))


def write_archives(spark: SparkSession, pages: DataFrame, out: str, least_bytes: int = LEAST_BYTES, archive_mb: int = 64) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) into archives under `out`; returns (path, records), a row each.

    Null html is an empty payload; null url is empty; other columns are ignored; an empty table gives no archive. File names
    carry the attempt that wrote them and only the manifest's count, so lost or repeated tasks do no harm.
    """
    scratch = Scratch(spark, "op7")

    def run(batches):
        fs, base = open_fs(out)
        fs.create_dir(base, recursive=True)
        z = None

        def finish():
            z.end()
            z.member(INDEX, "".join(lines).encode())
            z.close()
            file.close()
            return pa.RecordBatch.from_pydict({"path": [f"{out}/{name}"], "records": [len(lines)]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))

        for batch in batches:
            for page_id, url, html, top, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if z is None:
                    name, lines = f"{uuid.uuid4().hex}.wacz", []
                    file = fs.open_output_stream(f"{base}/{name}")
                    z = ZipWriter(file)
                    z.begin(WARC)
                payload = (html or "").encode("utf-8", "replace")
                rec = gz(record(page_id, url, payload, b32(hashlib.sha1(payload).digest()), top, revisit))
                lines.append(f"{'' if page_id is None else page_id} {json.dumps({'offset': z.size, 'length': len(rec)})}\n")
                z.write(rec)
                if z.size >= archive_mb << 20:
                    yield finish()
                    z = None
        if z is not None:
            yield finish()

    return scratch.save(plan(pages, least_bytes, scratch).mapInArrow(run, "path string, records long"), "manifest")


def open_zip(uri: str) -> ZipReader:
    fs, path = open_fs(uri)
    f = fs.open_input_file(path)
    return ZipReader(f, f.size())


def read_archives(manifest: DataFrame, step: int = 4 << 20) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of every record; a revisit's payload is null.

    A task reads the index of an archive and then its records in ranges of about `step` bytes; a response's payload is hashed
    anew and must have its digest, else the read fails.
    """

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                z = open_zip(path)  # closed at the end, or with the worker's error
                start, _ = z.data_at(WARC)
                spans = [json.loads(x.partition(" ")[2]) for x in z.read(INDEX).decode().splitlines()]
                i = 0
                while i < len(spans):
                    j, lo = i, spans[i]["offset"]
                    while j < len(spans) and (j == i or spans[j]["offset"] + spans[j]["length"] - lo <= step):
                        j += 1
                    blob = z.range(start + lo, spans[j - 1]["offset"] + spans[j - 1]["length"] - lo)
                    rows = []
                    for s in spans[i:j]:
                        r = parse(zlib.decompress(blob[s["offset"] - lo : s["offset"] - lo + s["length"]], 31))
                        kind, digest = r["warc-type"], r["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and b32(hashlib.sha1(r["body"]).digest()) != digest:
                            raise ValueError(f"digest differs in {path}")
                        size = int(r["http"]["content-length"]) if kind == "revisit" else len(r["body"])
                        rows.append((_urn(r["warc-record-id"]), r["warc-target-uri"], None if kind == "revisit" else r["body"], size, digest, kind, _urn(r.get("warc-refers-to")) if kind == "revisit" else None))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)
                    i = j
                z.file.close()

    n = max(1, manifest.count())
    return manifest.select("path").repartition(min(n, 10_000)).mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


_NAMES = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
_TYPES = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_archives() of the archives that write_archives() makes of all pages; null html is an empty payload."""
    out = Scratch(spark, "op7").path("archives")
    return read_archives(write_archives(spark, read(spark, sf_dir, "pages"), out)).drop("url", "payload")

"""Readers of what files hold: archive members, mail parts, cells, PDF structure, SVG, PNG and shortcut files.

Each is a plain function from bytes to parts; `parts` runs them over a file table by Arrow batches. A part is
(kind, name, text, n): a kind that detectors look for, a name, its text and a number.
"""

from __future__ import annotations

import csv
import email
import gzip
import hashlib
import io
import posixpath
import re
import struct
import sys
import tarfile
import zipfile
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

from ..vocab import EXTENSION_BUCKET, MAX_DEPTH, MAX_HELD, MAX_MEMBER, MAX_STREAM, MAX_TEXT, MAX_UNPACKED
from .batches import BATCH, bounded, rows_of
from .compound import ole_parts
from .pictures import PNG, picture, thumbnail_of
from .sevenzip import each as seven
from .sevenzip import is_7z
from .sevenzip import listed as seven_names

Part = tuple[str, str, str, int]


def text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def held(content: bytes | None, source: str | None, path: str):
    """The content, or the open file if a source left it out for its size; None if it was not read and cannot be opened."""
    if content is not None:
        return content
    if source is None or "!/" in path:
        return None
    import pyarrow.fs as pafs

    try:
        return pafs.FileSystem.from_uri(source)[0].open_input_file(path)
    except OSError:
        return None


def stream(raw):
    """A seekable file at its begin: of bytes, or the open file itself, of which only the parts asked for are read."""
    if isinstance(raw, bytes):
        return io.BytesIO(raw)
    raw.seek(0)
    return raw


# ---- ZIP and TAR -----------------------------------------------------------------------------------------------------


def safe(name: str) -> bool:
    """Whether a member stays below the folder it would be extracted to."""
    clean = posixpath.normpath("/x/" + name) if not name.startswith("/") else ""
    return clean == "/x" or clean.startswith("/x/")


def is_zip(raw) -> bool:
    return stream(raw).read(4) == b"PK\3\4"


def each_member(raw, path: str) -> Iterator[tuple[str, int, Callable[[], bytes]]]:
    """(name, size, read) of the safe members of a ZIP, TAR, 7z or gzip archive that are files; read() unpacks one."""
    if is_zip(raw):
        with zipfile.ZipFile(stream(raw)) as z:
            for i in z.infolist():
                if safe(i.filename) and not i.is_dir():
                    yield i.filename, i.file_size, lambda i=i: z.read(i)
    elif path.endswith((".tar", ".tar.gz", ".tgz")):
        with tarfile.open(fileobj=stream(raw)) as t:
            for m in t:
                if safe(m.name) and m.isfile():
                    yield m.name, m.size, lambda m=m: t.extractfile(m).read()
    elif is_7z(stream(raw)):
        yield from (m for m in seven(stream(raw), MAX_HELD) if safe(m[0]))
    elif stream(raw).read(2) == b"\x1f\x8b":
        yield gz_name(path), 0, lambda: gunzip(stream(raw))


def gz_name(path: str) -> str:
    """What a gzip file holds is named like it, without the ending."""
    return re.sub(r"(?i)\.gz$", "", path.rsplit("/", 1)[-1]) or "content"


def gunzip(f, most: int = MAX_HELD) -> bytes:
    with gzip.GzipFile(fileobj=f) as z:
        data = z.read(most + 1)
    if len(data) > most:
        raise ValueError("gzip file unpacks to more than the limit")
    return data


def members(raw, path: str) -> list[tuple[str, bytes]]:
    return [(name, read()) for name, _, read in each_member(raw, path)]


def oversized(raw, path: str) -> list[tuple[str, int]]:
    """Names and sizes of the members that are not unpacked for their size."""
    return [(name, n) for name, n, _ in each_member(raw, path) if n > MAX_HELD]


def names(raw, path: str) -> list[str]:
    """All member names, safe or not."""
    if is_zip(raw) or path.endswith(".zip"):
        with zipfile.ZipFile(stream(raw)) as z:
            return z.namelist()
    if path.endswith((".tar", ".tar.gz", ".tgz")):
        with tarfile.open(fileobj=stream(raw)) as t:
            return t.getnames()
    if is_7z(stream(raw)):
        return [m[0] for m in seven_names(stream(raw))]
    if stream(raw).read(2) == b"\x1f\x8b":
        return [gz_name(path)]
    return []


def encrypted(raw) -> str | None:
    """Name of the first member of a ZIP or 7z archive that needs a password."""
    if is_7z(stream(raw)):
        return next((m[0] for m in seven_names(stream(raw)) if m[3] is not None and m[3].locked), None)
    with zipfile.ZipFile(stream(raw)) as z:
        return next((i.filename for i in z.infolist() if i.flag_bits & 1), None)


def put_object(extract: str, owner: str, name: str, data: bytes) -> None:
    """Write an object below a URI, in a folder named after its file's hash; a repeated task writes the same bytes again."""
    import pyarrow.fs as pafs

    fs, base = pafs.FileSystem.from_uri(extract)
    fs.create_dir(f"{base}/{owner[:12]}", recursive=True)
    with fs.open_output_stream(f"{base}/{owner[:12]}/{name.replace('/', '_')}") as f:
        f.write(data)


def zip_parts(raw: bytes, path: str, owner: str = "", extract: str | None = None) -> Iterator[Part]:
    try:
        if (name := encrypted(raw)) is not None:
            yield "zip_encrypt", name, "", 0
            return
        with zipfile.ZipFile(stream(raw)) as z:
            for i in z.infolist():
                if i.is_dir():
                    continue
                if i.file_size > MAX_MEMBER:
                    yield "skipped", i.filename, f"document member over the limit: {i.filename}", i.file_size
                    continue
                try:
                    data = z.read(i)
                except Exception:  # noqa: BLE001 a broken member leaves the others readable
                    yield "zip_broken_member", i.filename, "", i.file_size
                    continue
                yield "zip_member", i.filename, text(data), i.file_size
                if any(k in i.filename.lower() for k in ("oleobject", "activex", "embeddings", "vbaproject", "embed")):
                    if extract:
                        put_object(extract, owner, i.filename, data)
                    yield "zip_embedded", i.filename, hashlib.sha256(data).hexdigest(), len(data)
    except Exception as e:  # noqa: BLE001 any parser error is a property of the file
        message = str(e)
        yield "zip_encrypt_error" if re.search("encrypted|password", message.lower()) else "error", "", message, 0


def archive_parts(raw: bytes, path: str, depth: int) -> Iterator[Part]:
    try:
        if is_zip(raw) or is_7z(stream(raw)) or path.lower().endswith(".zip"):
            if (name := encrypted(raw)) is not None:
                yield "archive_encrypt", name, "", depth
                return
        found = names(raw, path)
        if found:
            yield "archive", str(found[:10]), str(len(found)), depth
            for name, n in oversized(raw, path):
                yield "skipped", name, f"archive member over the limit: {name}", n
        elif not is_zip(raw):
            yield "archive_unread", "", "archive format has no reader", depth
    except Exception as e:  # noqa: BLE001
        message = str(e)
        yield "archive_encrypt_error" if re.search("encrypted|password", message.lower()) else "error", "", message, depth


def expand(raw: bytes, path: str, max_depth: int = MAX_DEPTH, depth: int = 0, budget: list[int] | None = None) -> Iterator[tuple[str, bytes | None, int]]:
    """(path, content, depth) of all members, archives within archives included: outer!/inner. Nothing is written to disk.

    Members are unpacked one at a time. What goes beyond MAX_UNPACKED bytes for one outer archive comes with content None.
    """
    budget = [MAX_UNPACKED] if budget is None else budget
    if depth >= max_depth:
        return
    try:
        if (is_zip(raw) or is_7z(stream(raw))) and encrypted(raw) is not None:
            return
    except Exception:  # noqa: BLE001 archive_parts reports it
        return
    found = each_member(raw, path)
    while True:
        try:
            name, size, read = next(found)
            inner = f"{path}!/{name}"
            if size > MAX_HELD:
                continue
            data = read() if size <= budget[0] else None
        except Exception:  # noqa: BLE001 the end, or a broken member
            return
        yield inner, data, depth + 1
        if data is None:
            continue
        budget[0] -= len(data)
        ext = re.search(r"[^/](\.[^./]+)$", name)
        if EXTENSION_BUCKET.get(ext[1].lower() if ext else "") == "archive" or (not (ext and ext[1].lower() in EXTENSION_BUCKET) and is_zip(data)):
            yield from expand(data, inner, max_depth, depth + 1, budget)


# ---- mail, cells, XML, shortcuts, PNG ----------------------------------------------------------------------------------


def mail_parts(raw: bytes, mhtml: bool) -> Iterator[Part]:
    msg = email.message_from_bytes(raw)
    for k, v in msg.items():
        yield "header", k, str(v), 0
    for n, part in enumerate(msg.walk()):
        for k, v in part.items():
            if mhtml and k.lower() == "content-location":
                yield "part_location", k, str(v), n
        body = part.get_payload(decode=True)
        if body:
            yield "part_body", part.get_content_type(), text(body), n


def cell_parts(raw: bytes, delimiter: str = ",") -> Iterator[Part]:
    """Cells that begin like a formula; the others can hold no finding. The text is decoded as it is read."""
    try:
        lines = io.TextIOWrapper(io.BytesIO(raw), "utf-8", "replace", newline="")
        for n, row in enumerate(csv.reader(lines, delimiter=delimiter)):
            for cell in row:
                cell = cell.strip()
                if cell[:1] in ("=", "+", "-", "@") and cell:
                    yield "cell", "", cell, n
    except csv.Error:
        return


def harmless(part: Part) -> bool:
    """A cell that detectors take for no formula, such as a negative number: neither a name after = nor a command."""
    return part[0] == "cell" and part[2][0] != "=" and "cmd|" not in part[2]


def xml_ok(raw: bytes) -> bool:
    """Whether it parses and declares no entity."""
    if re.search(rb"<!ENTITY", raw):
        return False
    try:
        ElementTree.fromstring(raw)
    except ElementTree.ParseError:
        return False
    return True


def svg_parts(raw: bytes) -> Iterator[Part]:
    if not xml_ok(raw):
        return
    for e in ElementTree.fromstring(raw).iter():
        tag = str(e.tag)
        for k, v in e.attrib.items():
            if k.endswith("href"):
                yield "href", tag, v, 0
        if "script" in tag.lower():
            yield "script", tag, "", 0


def lnk_parts(raw: bytes) -> Iterator[Part]:
    """Paths of a shell link, after its public layout: header, optional id list, link info, then strings."""
    if len(raw) < 76 or struct.unpack_from("<I", raw)[0] != 76:
        return
    flags, at = struct.unpack_from("<I", raw, 20)[0], 76
    if flags & 1:
        at += 2 + struct.unpack_from("<H", raw, at)[0]
    zero = lambda p: raw[p : raw.index(b"\0", p)].decode("cp1252", "replace")
    if flags & 2:
        size, _, kind, _, base, net, tail = struct.unpack_from("<7I", raw, at)
        end = zero(at + tail)
        if kind & 1:
            yield "lnk_local_path", "", zero(at + base) + end, 0
        if kind & 2:
            share = zero(at + net + struct.unpack_from("<I", raw, at + net + 8)[0])
            yield "lnk_network_path", "", share + ("\\" + end if end else ""), 0
        at += size
    for bit in (4, 8, 16, 32, 64):
        if flags & bit:
            n = struct.unpack_from("<H", raw, at)[0]
            width = 2 if flags & 128 else 1
            value = raw[at + 2 : at + 2 + n * width].decode("utf-16-le" if width == 2 else "cp1252", "replace")
            at += 2 + n * width
            if bit == 8:
                yield "lnk_path", "", value, 0


def png_parts(raw: bytes) -> Iterator[Part]:
    """Faults of the chunk structure."""
    if raw[:8] != PNG:
        yield "png_fault", "", "not a PNG signature", 0
        return
    at, last = 8, b""
    while at + 12 <= len(raw):
        n, kind = struct.unpack_from(">I4s", raw, at)
        if at + 12 + n > len(raw):
            yield "png_fault", kind.decode("latin-1"), "chunk runs past the end", at
            return
        if zlib.crc32(raw[at + 4 : at + 8 + n]) != struct.unpack_from(">I", raw, at + 8 + n)[0]:
            yield "png_fault", kind.decode("latin-1"), "CRC differs", at
        at, last = at + 12 + n, kind
        if kind == b"IEND":
            break
    if last != b"IEND":
        yield "png_fault", "", "no IEND chunk", at
    elif at < len(raw):
        yield "png_fault", "", f"{len(raw) - at} bytes after IEND", at


def picture_parts(raw: bytes, extension: str) -> Iterator[Part]:
    """Tags of a picture, faults of a PNG, and how far a thumbnail is from its picture: both aspects, and differing bits of 64 (-1: unknown)."""
    if extension == ".png":
        yield from png_parts(raw)
    for name, value in picture(raw)[0].items():
        yield "image_tag", name, value, 0
    if (found := thumbnail_of(raw)) is not None:
        a, b, main, small = found
        bits = -1 if main is None else sum((x > sum(main) / 64) != (y > sum(small) / 64) for x, y in zip(main, small, strict=True))
        yield "thumbnail", f"{a:.2f}", f"{b:.2f}", bits


# ---- PDF -------------------------------------------------------------------------------------------------------------

#: names that a keyword count looks for; fixed values
KEYWORDS = ["/Page", "/Encrypt", "/ObjStm", "/JS", "/JavaScript", "/AA", "/OpenAction", "/AcroForm", "/JBIG2Decode", "/RichMedia", "/Launch", "/EmbeddedFile", "/XFA"]
TERMS = ["/URI", "/Launch", "/GoToR", "/AcroForm", "/OCProperties", "/OCG", "/Sig"]
_NAME = re.compile(rb"/(?:[A-Za-z0-9]|#[0-9A-Fa-f]{2})+")
_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)(?=\bendobj\b|\d+\s+\d+\s+obj\b|\Z)", re.S)
_TRAILER = re.compile(rb"\btrailer\b(.*?)(?=\bstartxref\b|\Z)", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)


def unescape_names(raw: bytes) -> bytes:
    """#xx inside names as the byte it stands for."""
    return _NAME.sub(lambda m: re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m[0]), raw)


def pdf_keywords(raw: bytes) -> dict[str, int]:
    """Counts of KEYWORDS as whole names; empty if there is no %PDF in the first 1024 bytes."""
    if b"%PDF" not in raw[:1024]:
        return {}
    found = Counter(m[0].decode("latin-1") for m in _NAME.finditer(unescape_names(raw)))
    return {k: found[k] for k in KEYWORDS}


def inflate(data: bytes, most: int = MAX_STREAM) -> bytes | None:
    """Inflated data, no more than `most` bytes."""
    for bits in (15, -15):
        try:
            return zlib.decompressobj(bits).decompress(data, most)
        except zlib.error:
            continue
    return None


def pdf_objects(raw: bytes) -> list[tuple[str, str]]:
    """(number and generation, dictionary text before any stream) of indirect objects, and trailers; names unescaped."""
    out = []
    for m in _OBJECT.finditer(raw):
        head = re.split(rb"\bstream\r?\n", m[3], maxsplit=1)[0]
        out.append((f"{int(m[1])} {int(m[2])}", unescape_names(head).decode("latin-1")))
    return out + [("trailer", unescape_names(m[1]).decode("latin-1")) for m in _TRAILER.finditer(raw)]


def _value(body: str, at: int) -> str | None:
    """The PDF value at a place: literal string with escapes and nesting, hex string, name or other token."""
    while at < len(body) and body[at].isspace():
        at += 1
    if at >= len(body):
        return None
    if body[at] == "(":
        out, depth, i = [], 0, at
        while i < len(body):
            c = body[i]
            if c == "\\" and i + 1 < len(body):
                octal = re.match(r"[0-7]{1,3}", body[i + 1 : i + 4])
                if octal:
                    out.append(chr(int(octal[0], 8) & 255))
                    i += len(octal[0]) + 1
                    continue
                out.append({"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "\n": ""}.get(body[i + 1], body[i + 1]))
                i += 2
                continue
            if c == "(":
                depth += 1
                if depth == 1:
                    i += 1
                    continue
            elif c == ")":
                depth -= 1
                if not depth:
                    return "".join(out)
            out.append(c)
            i += 1
        return "".join(out)
    if body[at] == "<" and body[at : at + 2] != "<<":
        return body[at + 1 : body.find(">", at)] if ">" in body[at:] else None
    m = re.compile(r"/?[^\s/<>()\[\]]+").match(body, at)
    return m[0] if m else None


def form_fields(raw: bytes) -> list[dict[str, str]]:
    """Fields (obj, ft, t, tu, v) of the objects that have a field type."""
    out = []
    for number, body in pdf_objects(raw):
        row = {"obj": number}
        for key in ("FT", "T", "TU", "V"):
            m = re.search(rf"/{key}(?![A-Za-z0-9])", body)
            if m and (v := _value(body, m.end())) is not None:
                row[key.lower()] = v
        if row.get("ft"):
            out.append(row)
    return out


def pdf_parts(raw: bytes) -> Iterator[Part]:
    whole = len(raw) <= MAX_TEXT
    if whole and (n := raw.count(b"%%EOF")) > 1:
        yield "pdf_eof", "", "", n
    for m in _STREAM.finditer(raw):
        data = inflate(m[1])
        if data:
            yield "pdf_stream", "", data.decode("utf-8", "ignore"), 0
            if len(data) >= MAX_STREAM:
                yield "skipped", "", "a stream is read no further than its limit", len(data)
    if whole:
        yield "pdf_raw", "", raw.decode("utf-8", "ignore"), 0
    else:
        yield "skipped", "", "file over the text limit, only its keywords, objects and streams were read", len(raw)
    for k, n in pdf_keywords(raw).items():
        yield "pdf_keyword", k, "", n
    objects = pdf_objects(raw)
    for term in TERMS:
        found = [f"obj {k}\n{body}" for k, body in objects if term.lower() in body.lower()]
        if found:
            yield "pdf_objects", term, "\n".join(found), len(found)
    if n := len(re.findall(rb"/Subtype\s*/Image\b", raw)):
        yield "pdf_images", "", "", n


# ---- over a table ------------------------------------------------------------------------------------------------------

PART = "path string, sha256 string, bucket string, extension string, part long, kind string, name string, text string, n long"


#: pictures whose tags are read
PICTURES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".gif")


def parts_of(path: str, bucket: str, extension: str, raw, depth: int = 0, owner: str = "", extract: str | None = None) -> Iterator[Part]:
    """Parts of one file, by its bucket. Instead of bytes, large files come open: containers read parts of them, PDF files and pictures all."""
    if not isinstance(raw, bytes):
        text_kind = extension in (".lnk", ".mht", ".mhtml", ".svg") or bucket in ("email", "csv", "xml", "ole")
        if raw is None or text_kind:
            yield "skipped", "", "file over the text limit" if raw is not None else "content was not read", 0
            return
        if bucket not in ("ooxml", "odf", "archive"):
            raw = raw.read() if bucket == "pdf" or extension in PICTURES else b""
    if extension == ".lnk":
        yield from lnk_parts(raw)
    elif bucket == "ooxml":
        yield from zip_parts(raw, path, owner, extract)
    elif bucket == "odf":
        yield from (p for p in zip_parts(raw, path) if p[0] != "zip_encrypt")
    elif bucket == "email" or extension in (".mht", ".mhtml"):
        yield from mail_parts(raw, extension in (".mht", ".mhtml"))
    elif bucket == "csv":
        yield from cell_parts(raw)
    elif bucket == "xml":
        yield "xml", "ok" if xml_ok(raw) else "bad", text(raw), 0
    elif extension == ".svg":
        yield from svg_parts(raw)
    elif bucket == "image":
        yield from picture_parts(raw, extension)
    elif bucket == "pdf":
        yield from pdf_parts(raw)
    elif bucket == "ole":
        yield from ole_parts(raw, path)
    elif bucket == "archive":
        yield from archive_parts(raw, path, depth)


def parts(files: DataFrame, source: str | None = None, extract: str | None = None, budget: int = BATCH) -> DataFrame:
    """Parts of each file row (path, sha256, bucket, extension, content); what cannot be parsed gives one `error` part.

    Rows without content are opened by their path where read_files found them, at the URI `source`. Batches hold about `budget` bytes
    of Python objects, and files are taken one at a time, so neither a file with much in it nor a batch of files gathers in a worker. Embedded objects of documents are written below `extract`.
    """
    types = [pa.string()] * 4 + [pa.int64()] + [pa.string()] * 3 + [pa.int64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array([_valid(v) for v in c] if t == pa.string() else c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in PART.split(", ")])

    def made(path: str, sha: str | None, bucket: str, ext: str, raw) -> Iterator[Part]:
        try:
            yield from parts_of(path, bucket, ext, held(raw, source, path), path.count("!/"), sha or "", extract)
        except Exception as e:  # noqa: BLE001 one bad file must not end the stage
            yield "error", "", str(e), 0

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for path, sha, bucket, ext, raw in rows_of(batch):
                for k, part in enumerate(made(path, sha, bucket, ext, raw)):
                    if harmless(part):  # the others keep their places
                        continue
                    rows.append((path, sha, bucket, ext, k, *part))
                    # a row's tuple and numbers, and its path and hash once more in the batch
                    size += sys.getsizeof(part[1]) + sys.getsizeof(part[2]) + len(path) + 300
                    if size >= budget:
                        yield batch_of(rows)
                        rows, size = [], 0
            yield batch_of(rows)

    return bounded(files.select("path", "sha256", "bucket", "extension", "content")).mapInArrow(run, PART)


def _valid(v: str | None) -> str | None:
    """Without lone surrogates, which mail headers may hold."""
    return v.encode("utf-8", "replace").decode("utf-8") if v is not None else None


def archive_members(files: DataFrame, max_depth: int = MAX_DEPTH, source: str | None = None) -> DataFrame:
    """File rows (path, sha256, size, mtime, content) of all members of the archives in `files`, nested ones too; source as in parts.

    Archives are taken one at a time, and members leave in batches of about BATCH bytes.
    """
    schema = "path string, sha256 string, size long, mtime timestamp, content binary"
    types = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[f.split()[0] for f in schema.split(", ")])

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for path, raw in rows_of(batch):
                for inner, data, _ in expand(held(raw, source, path) or b"", path, max_depth):
                    n = len(data or b"")
                    if rows and size + n > BATCH:  # a large member goes alone
                        yield batch_of(rows)
                        rows, size = [], 0
                    rows.append((inner, *((hashlib.sha256(data).hexdigest(), n) if data is not None else (None, None)), None, data))
                    size += n + len(inner) + 500
            if rows:
                yield batch_of(rows)

    return bounded(files.where("bucket = 'archive'").select("path", "content")).mapInArrow(run, schema)

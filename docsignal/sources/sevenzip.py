"""Members of 7z archives, after the public description of the format: stored, LZMA, LZMA2, Deflate and BZip2 streams, with or without
the x86 filter. Encrypted archives and other methods are refused with a message."""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

MAGIC = b"7z\xbc\xaf\x27\x1c"
END, HEADER, FILES, PACK, UNPACK, SUBSTREAMS, SIZES, DIGESTS, FOLDERS, CODER_SIZES, COUNTS, EMPTY, NAMES, ENCODED = 0, 1, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 17, 23
COPY, LZMA2, LZMA1, X86, DEFLATE, BZIP2, AES = b"\x00", b"\x21", b"\x03\x01\x01", b"\x03\x03\x01\x03", b"\x04\x01\x08", b"\x04\x02\x02", b"\x06\xf1\x07\x01"


class Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("7z header ends early")
        self.at += n
        return out

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        """The leading ones of the first byte say how many bytes follow, lowest first; its other bits are the highest."""
        first, value = self.byte(), 0
        for k in range(8):
            if not first & (0x80 >> k):
                return value | (first & ((0x80 >> k) - 1)) << 8 * k
            value |= self.byte() << 8 * k
        return value

    def flags(self, n: int) -> list[bool]:
        raw = self.take((n + 7) // 8)
        return [bool(raw[k >> 3] & 0x80 >> (k & 7)) for k in range(n)]

    def some_flags(self, n: int) -> list[bool]:
        return [True] * n if self.byte() else self.flags(n)


@dataclass
class Folder:
    """A chain of coders over one packed stream."""

    coders: list[tuple[bytes, bytes]]
    at: int = 0
    packed: int = 0
    sizes: list[int] = field(default_factory=list)
    files: int = 1
    pieces: list[int] = field(default_factory=list)

    @property
    def locked(self) -> bool:
        return any(name == AES for name, _ in self.coders)

    @property
    def size(self) -> int:
        return self.sizes[0] if self.sizes else 0


def _folder(c: Cursor) -> Folder:
    coders, streams = [], 0
    for _ in range(c.number()):
        flag = c.byte()
        name = c.take(flag & 15)
        if flag & 0x10 and (c.number(), c.number()) != (1, 1):
            raise ValueError("7z method with several streams is not read")
        coders.append((name, c.take(c.number()) if flag & 0x20 else b""))
        streams += 1
    for _ in range(streams - 1):
        c.number(), c.number()
    return Folder(coders)


def _digests(c: Cursor, n: int) -> int:
    known = sum(c.some_flags(n))
    c.take(4 * known)
    return known


def _streams(c: Cursor) -> list[Folder]:
    folders: list[Folder] = []
    base, packed, digests = 0, [], set()
    while (kind := c.byte()) != END:
        if kind == PACK:
            base, n = c.number(), c.number()
            while (kind := c.byte()) != END:
                if kind == SIZES:
                    packed = [c.number() for _ in range(n)]
                elif kind == DIGESTS:
                    _digests(c, n)
        elif kind == UNPACK:
            while (kind := c.byte()) != END:
                if kind == FOLDERS:
                    n = c.number()
                    if c.byte():
                        raise ValueError("7z folders kept elsewhere are not read")
                    folders = [_folder(c) for _ in range(n)]
                elif kind == CODER_SIZES:
                    for f in folders:
                        f.sizes = [c.number() for _ in f.coders]
                elif kind == DIGESTS:
                    known = c.some_flags(len(folders))
                    c.take(4 * sum(known))
                    digests = {k for k, yes in enumerate(known) if yes}
        elif kind == SUBSTREAMS:
            while (kind := c.byte()) != END:
                if kind == COUNTS:
                    for f in folders:
                        f.files = c.number()
                elif kind == SIZES:
                    for f in folders:
                        f.pieces = [c.number() for _ in range(max(0, f.files - 1))]
                elif kind == DIGESTS:
                    _digests(c, sum(f.files for k, f in enumerate(folders) if f.files != 1 or k not in digests))
    for f, n in zip(folders, packed, strict=False):
        f.at, f.packed = 32 + base, n
        base += n
    for f in folders:
        f.pieces = [*f.pieces[: max(0, f.files - 1)], f.size - sum(f.pieces)] if f.files else []
    return folders


def _unpack(f: Folder, data: bytes) -> bytes:
    """The stream of a folder. Coders come with the last one to apply first."""
    if f.locked:
        raise ValueError("7z archive is encrypted: password needed")
    filters = []
    for k, (name, props) in enumerate(f.coders):
        last = k == len(f.coders) - 1
        if name == X86:
            filters.append({"id": lzma.FILTER_X86})
        elif name == LZMA2 and last:
            bits = props[0]
            filters.append({"id": lzma.FILTER_LZMA2, "dict_size": 0xFFFFFFFF if bits == 40 else (2 | bits & 1) << (bits // 2 + 11)})
        elif name == LZMA1 and last:
            b, size = struct.unpack("<BI", props[:5])
            filters.append({"id": lzma.FILTER_LZMA1, "lc": b % 9, "lp": b // 9 % 5, "pb": b // 45, "dict_size": max(4096, size)})
        elif len(f.coders) == 1 and name == COPY:
            return data[: f.size]
        elif len(f.coders) == 1 and name == DEFLATE:
            return zlib.decompressobj(-15).decompress(data, f.size)
        elif len(f.coders) == 1 and name == BZIP2:
            return bz2.BZ2Decompressor().decompress(data, f.size)
        else:
            raise ValueError(f"7z method {name.hex()} is not read")
    return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=filters).decompress(data, f.size)


def is_7z(stream) -> bool:
    return stream.read(6) == MAGIC


def listed(stream, most: int = 64 << 20) -> list[tuple[str, bool, int, Folder | None, int]]:
    """(name, whether it is a file with content, size, folder, place in the folder's stream) of all members."""
    head = stream.read(32)
    if head[:6] != MAGIC or len(head) < 32:
        raise ValueError("not a 7z archive")
    offset, size = struct.unpack_from("<QQ", head, 12)
    if not size:
        return []
    if size > most:
        raise ValueError("7z header is over the limit")
    stream.seek(32 + offset)
    c = Cursor(stream.read(size))
    kind = c.byte()
    while kind == ENCODED:
        (f,) = _streams(c)
        if f.size > most:
            raise ValueError("7z header is over the limit")
        stream.seek(f.at)
        c = Cursor(_unpack(f, stream.read(f.packed)))
        kind = c.byte()
    if kind != HEADER:
        raise ValueError("no 7z header")
    folders: list[Folder] = []
    names, empty = [], []
    while (kind := c.byte()) != END:
        if kind == 4:  # streams
            folders = _streams(c)
        elif kind == FILES:
            n = c.number()
            empty = [False] * n
            while (kind := c.byte()) != END:
                part = Cursor(c.take(c.number()))
                if kind == EMPTY:
                    empty = part.flags(n)
                elif kind == NAMES:
                    if part.byte():
                        raise ValueError("7z names kept elsewhere are not read")
                    names = part.data[1:].decode("utf-16-le", "replace").split("\0")[:n]
        else:
            c.take(c.number())
    places = [(f, sum(f.pieces[:k]), f.pieces[k]) for f in folders for k in range(f.files)]
    out, held = [], iter(places)
    for name, bare in zip(names, empty, strict=False):
        f, at, size = (None, 0, 0) if bare else next(held, (None, 0, 0))
        out.append((name, not bare, size, f, at))
    return out


def each(stream, most: int) -> Iterator[tuple[str, int, Callable[[], bytes]]]:
    """(name, size, read) of the files; one folder's stream is held at a time. Members of folders over `most` bytes count with that size."""
    held: dict[int, bytes] = {}

    def read(f: Folder, at: int, size: int) -> bytes:
        if id(f) not in held:
            held.clear()
            stream.seek(f.at)
            held[id(f)] = _unpack(f, stream.read(f.packed))
        return held[id(f)][at : at + size]

    for name, some, size, f, at in listed(stream):
        if some and f is not None:
            yield name, size if f.size <= most else f.size, lambda f=f, at=at, size=size: read(f, at, size)

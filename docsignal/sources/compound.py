"""Compound files (OLE2) after their public layout: streams, macro source, Outlook message properties."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_END = 0xFFFFFFFA  # this and above are marks, not sectors


class Compound:
    """Storages and streams of a compound file held in memory; chains that run in circles end where they began to repeat."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC or len(raw) < 512:
            raise ValueError("not a compound file")
        self.raw = raw
        shift, mini = struct.unpack_from("<HH", raw, 30)
        self.size, self.mini_size = 1 << shift, 1 << mini
        _, first_dir, _, self.cutoff, first_mini, _, first_difat, _ = struct.unpack_from("<8I", raw, 44)
        tables = [s for s in struct.unpack_from("<109I", raw, 76) if s < _END]
        seen = set()
        while first_difat < _END and first_difat not in seen:
            seen.add(first_difat)
            block = struct.unpack(f"<{self.size // 4}I", self._sector(first_difat))
            tables += [s for s in block[:-1] if s < _END]
            first_difat = block[-1]
        self.fat = [x for s in tables for x in struct.unpack(f"<{self.size // 4}I", self._sector(s))]
        self.entries = [self._entry(e) for e in re.findall(rb"(?s).{128}", self._chain(first_dir))]
        mini_fat = self._chain(first_mini) if first_mini < _END else b""
        self.mini_fat = list(struct.unpack(f"<{len(mini_fat) // 4}I", mini_fat))
        root = self.entries[0]
        self.mini = self._chain(root["start"])[: root["size"]] if root["start"] < _END else b""

    def _sector(self, n: int) -> bytes:
        at = (n + 1) * self.size
        return self.raw[at : at + self.size].ljust(self.size, b"\0")

    def _chain(self, n: int) -> bytes:
        out, seen = [], set()
        while n < _END and n not in seen and n < len(self.fat):
            seen.add(n)
            out.append(self._sector(n))
            n = self.fat[n]
        return b"".join(out)

    @staticmethod
    def _entry(e: bytes) -> dict:
        length, kind = struct.unpack_from("<HB", e, 64)
        left, right, child = struct.unpack_from("<III", e, 68)
        start, size = struct.unpack_from("<IQ", e, 116)
        return {"name": e[: max(0, length - 2)].decode("utf-16-le", "replace"), "kind": kind, "left": left, "right": right, "child": child, "start": start, "size": size & 0xFFFFFFFF}

    def _data(self, e: dict) -> bytes:
        if e["size"] >= self.cutoff:
            return self._chain(e["start"])[: e["size"]]
        out, n, seen = [], e["start"], set()
        while n < _END and n not in seen and n < len(self.mini_fat):
            seen.add(n)
            out.append(self.mini[n * self.mini_size : (n + 1) * self.mini_size])
            n = self.mini_fat[n]
        return b"".join(out)[: e["size"]]

    def streams(self) -> Iterator[tuple[list[str], bytes]]:
        """(path, data) of every stream."""
        todo, seen = [(self.entries[0]["child"], [])], set()
        while todo:
            n, path = todo.pop()
            if n >= len(self.entries) or n in seen:
                continue
            seen.add(n)
            e = self.entries[n]
            todo += [(e["right"], path), (e["left"], path)]
            if e["kind"] == 1:
                todo.append((e["child"], [*path, e["name"]]))
            elif e["kind"] == 2:
                yield [*path, e["name"]], self._data(e)


def expand_macro(data: bytes) -> bytes:
    """Macro source from its compressed container: chunks of literals and copies whose offset and length share 16 bits."""
    out, at = bytearray(), 1
    while at + 2 <= len(data):
        head = struct.unpack_from("<H", data, at)[0]
        if head >> 12 & 7 != 3:
            break
        end, at, base = min(len(data), at + (head & 0xFFF) + 3), at + 2, len(out)
        if not head >> 15:
            out += data[at : at + 4096]
            at = end
            continue
        while at < end:
            flags, at = data[at], at + 1
            for bit in range(8):
                if at >= end:
                    break
                if not flags >> bit & 1:
                    out.append(data[at])
                    at += 1
                    continue
                if at + 2 > end:
                    return bytes(out)
                token, at = struct.unpack_from("<H", data, at)[0], at + 2
                width = max(4, (len(out) - base - 1).bit_length())
                length, back = (token & (0xFFFF >> width)) + 3, (token >> (16 - width)) + 1
                if back > len(out):
                    return bytes(out)
                for _ in range(length):
                    out.append(out[-back])
    return bytes(out)


def macros(path: list[str], data: bytes) -> str:
    """Source text in a stream of a macro storage; every module begins with an attribute line."""
    at = data.find(b"\0Attribut")
    return expand_macro(data[at - 3 :]).decode("cp1252", "replace") if at >= 3 and data[at - 3] == 1 else ""


def ole_parts(raw: bytes, path: str) -> Iterator[tuple[str, str, str, int]]:
    """Streams as UTF-8 and UTF-16 text, macro source, embedded objects; of .msg files also the HTML body and header lines."""
    if raw[:8] != MAGIC:
        return
    source, embedded, body, heads = [], [], "", ""
    for names, data in Compound(raw).streams():
        name = "/".join(names)
        yield "ole_stream", name, data.decode("utf-8", "replace"), len(data)
        yield "ole_stream", name, data.decode("utf-16", "replace"), len(data)
        if text := macros(names, data):
            source.append(text)
        if "Ole10Native" in names[-1] or names[-1] == "Package" or any(n.startswith(("MBD", "_12")) for n in names[:-1]):
            embedded.append(name)
        if names[-1].startswith("__substg1.0_1013") and len(names) == 1:
            body = data.decode("utf-16-le" if names[-1].endswith("1F") else "utf-8", "replace")
        if names[-1].startswith("__substg1.0_007D") and len(names) == 1:
            heads = data.decode("utf-16-le" if names[-1].endswith("1F") else "cp1252", "replace")
    if source:
        yield "ole_vba", "", "\n".join(source), len(source)
    if embedded:
        yield "ole_embedded", ", ".join(embedded), "", len(embedded)
    if path.endswith(".msg"):
        if body:
            yield "msg_html", "", body, 0
        for k, v in re.findall(r"(?m)^([\w-]+):[ \t]*(.*(?:\r?\n[ \t].*)*)", heads):
            yield "msg_header", k, re.sub(r"\r?\n[ \t]+", " ", v).strip(), 0

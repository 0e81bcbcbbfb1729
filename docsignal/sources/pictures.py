"""Readers of picture files: sizes, tags, thumbnails and pixels, after the public layouts of JPEG, TIFF/EXIF, XMP, PNG and GIF."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

# Numbers of the EXIF standard and the names that tag readers give them.
TIFF_TAGS = {
    0x0100: "ImageWidth",
    0x0101: "ImageHeight",
    0x010E: "ImageDescription",
    0x010F: "Make",
    0x0110: "CameraModelName",
    0x0131: "Software",
    0x0132: "ModifyDate",
    0x013B: "Artist",
    0x013C: "HostComputer",
    0x8298: "Copyright",
    0x9003: "DateTimeOriginal",
    0x9286: "UserComment",
    0x9C9B: "Title",
    0x9C9C: "Comment",
    0x9C9D: "Author",
    0x9C9E: "Keywords",
    0x9C9F: "Subject",
    0xA002: "ExifImageWidth",
    0xA003: "ExifImageHeight",
    0xA420: "ImageUniqueID",
    0xA430: "OwnerName",
    0xA431: "SerialNumber",
    0xA434: "LensModel",
    0xA435: "LensSerialNumber",
    0xC62F: "InternalSerialNumber",
}
GPS_TAGS = {1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 6: "GPSAltitude"}
EXIF_FOLDER, GPS_FOLDER, THUMB_AT, THUMB_SIZE = 0x8769, 0x8825, 0x0201, 0x0202
#: bytes of a value by its type
WIDTHS = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
PNG = b"\x89PNG\r\n\x1a\n"


class Tiff:
    """Folders of tags in a TIFF block, which EXIF data are too."""

    def __init__(self, raw: bytes):
        self.raw, self.order = raw, {b"II": "<", b"MM": ">"}.get(raw[:2], "")
        if not self.order or len(raw) < 8 or struct.unpack_from(self.order + "H", raw, 2)[0] != 42:
            raise ValueError("no TIFF header")

    def value(self, kind: int, n: int, field: bytes):
        size = WIDTHS.get(kind, 0) * n
        at = struct.unpack(self.order + "I", field)[0]
        data = field[:size] if size <= 4 else self.raw[at : at + size]
        if not size or len(data) < size:
            return None
        if kind == 2:
            return data.split(b"\0")[0].decode("utf-8", "replace").strip()
        if kind in (1, 6, 7):
            return data
        if kind in (5, 10):
            pairs = struct.unpack(f"{self.order}{2 * n}{'I' if kind == 5 else 'i'}", data)
            return [a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
        return list(struct.unpack(f"{self.order}{n}{ {3: 'H', 4: 'I', 8: 'h', 9: 'i', 11: 'f', 12: 'd'}[kind]}", data))

    def folder(self, at: int) -> tuple[dict[int, object], int]:
        """(values by tag, place of the next folder) of the folder at a place."""
        if at + 2 > len(self.raw):
            return {}, 0
        (n,), out = struct.unpack_from(self.order + "H", self.raw, at), {}
        for k in range(n):
            p = at + 2 + 12 * k
            if p + 12 > len(self.raw):
                return out, 0
            tag, kind, count = struct.unpack_from(self.order + "HHI", self.raw, p)
            out[tag] = self.value(kind, count, self.raw[p + 8 : p + 12])
        end = at + 2 + 12 * n
        return out, struct.unpack_from(self.order + "I", self.raw, end)[0] if end + 4 <= len(self.raw) else 0


def _shown(tag: int, v) -> str:
    if isinstance(v, bytes):
        if 0x9C9B <= tag <= 0x9C9F:
            return v.decode("utf-16-le", "replace").rstrip("\0")
        return (v[8:] if tag == 0x9286 else v).decode("utf-8", "replace").strip("\0 ")
    if isinstance(v, list):
        return " ".join(f"{x:g}" if isinstance(x, float) else str(x) for x in v)
    return str(v)


def exif(raw: bytes) -> tuple[dict[str, str], bytes | None]:
    """(tags, thumbnail) of a TIFF block; GPS positions in degrees."""
    t = Tiff(raw)
    first, after = t.folder(struct.unpack_from(t.order + "I", raw, 4)[0])
    tags: dict[str, str] = {}

    def put(folder: dict, names: dict[int, str]) -> None:
        for tag, name in names.items():
            if folder.get(tag) not in (None, "", b""):
                tags.setdefault(name, _shown(tag, folder[tag]))

    put(first, TIFF_TAGS)
    for tag, names in ((EXIF_FOLDER, TIFF_TAGS), (GPS_FOLDER, GPS_TAGS)):
        if isinstance(first.get(tag), list):
            folder = t.folder(first[tag][0])[0]
            if names is GPS_TAGS:
                for key, ref in ((2, 1), (4, 3)):
                    if isinstance(folder.get(key), list) and len(folder[key]) == 3:
                        d, m, s = folder[key]
                        folder[key] = [(-1 if folder.get(ref) in ("S", "W") else 1) * (d + m / 60 + s / 3600)]
            put(folder, names)
    if "GPSLatitude" in tags and "GPSLongitude" in tags:
        tags["GPSPosition"] = f"{tags['GPSLatitude']} {tags['GPSLongitude']}"
    thumb = None
    if after:
        second = t.folder(after)[0]
        at, size = second.get(THUMB_AT), second.get(THUMB_SIZE)
        if isinstance(at, list) and isinstance(size, list) and at[0] + size[0] <= len(raw):
            thumb = raw[at[0] : at[0] + size[0]]
    return tags, thumb


def xmp(raw: bytes) -> dict[str, str]:
    """Simple properties of an XMP packet: attributes, elements, first items of lists; names without their prefix."""
    body = raw.decode("utf-8", "replace")
    out: dict[str, str] = {}
    for name, value in re.findall(r"\b[A-Za-z][\w-]*:([A-Za-z]\w*)\s*=\s*\"([^\"]*)\"", body):
        if name not in ("about", "parseType") and not value.startswith("http://ns.") and value:
            out.setdefault(name, value)
    for name, value in re.findall(r"<[A-Za-z][\w-]*:([A-Za-z]\w*)[^<>]*>\s*(?:<rdf:(?:Seq|Bag|Alt)>\s*<rdf:li[^<>]*>)?([^<>]+?)\s*<", body):
        if value.strip() and name != "li":
            out.setdefault(name, value.strip())
    return out


def jpeg_segments(raw: bytes):
    """(marker, data) of the segments before the first scan."""
    at = 2
    while at + 4 <= len(raw) and raw[at] == 0xFF:
        marker = raw[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in (0xD9, 0xDA):
            return
        n = struct.unpack_from(">H", raw, at + 2)[0]
        yield marker, raw[at + 4 : at + 2 + n]
        at += 2 + n


def png_chunks(raw: bytes):
    """(kind, data) of whole chunks."""
    at = 8
    while at + 12 <= len(raw):
        n, kind = struct.unpack_from(">I4s", raw, at)
        if at + 12 + n > len(raw):
            return
        yield kind, raw[at + 8 : at + 8 + n]
        at += 12 + n


def png_text(kind: bytes, data: bytes, most: int = 16 << 20) -> tuple[str, str] | None:
    """(key, text) of a tEXt, zTXt or iTXt chunk."""
    key, _, rest = data.partition(b"\0")
    name = key.decode("latin-1")
    try:
        if kind == b"tEXt":
            return name, rest.decode("latin-1")
        if kind == b"zTXt":
            return name, zlib.decompressobj().decompress(rest[1:], most).decode("latin-1")
        if kind == b"iTXt":
            packed = rest[:1] == b"\1"
            body = rest[2:].split(b"\0", 2)[2]
            return name, (zlib.decompressobj().decompress(body, most) if packed else body).decode("utf-8", "replace")
    except (zlib.error, IndexError):
        return None
    return None


def picture(raw: bytes) -> tuple[dict[str, str], bytes | None]:
    """(tags, thumbnail) of a JPEG, TIFF, PNG or GIF file; a broken block of tags leaves the others."""
    tags: dict[str, str] = {}
    thumb = None

    def block(data: bytes) -> None:
        nonlocal thumb
        try:
            found, small = exif(data)
        except (ValueError, struct.error):
            return
        for k, v in found.items():
            tags.setdefault(k, v)
        thumb = thumb or small

    if raw[:3] == b"\xff\xd8\xff":
        for marker, data in jpeg_segments(raw):
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(data) >= 5:
                h, w = struct.unpack_from(">HH", data, 1)
                tags["ImageWidth"], tags["ImageHeight"] = str(w), str(h)
            elif marker == 0xE1 and data.startswith(b"Exif\0\0"):
                block(data[6:])
            elif marker == 0xE1 and data.startswith(b"http://ns.adobe.com/xap/1.0/\0"):
                for k, v in xmp(data[29:]).items():
                    tags.setdefault(k, v)
            elif marker == 0xFE:
                tags.setdefault("Comment", data.decode("utf-8", "replace").strip("\0"))
    elif raw[:4] in (b"II*\0", b"MM\0*"):
        block(raw)
    elif raw[:8] == PNG:
        for kind, data in png_chunks(raw):
            if kind == b"IHDR" and len(data) >= 8:
                tags["ImageWidth"], tags["ImageHeight"] = map(str, struct.unpack_from(">II", data))
            elif kind == b"eXIf":
                block(data)
            elif (pair := png_text(kind, data)) is not None:
                if pair[0] == "XML:com.adobe.xmp":
                    for k, v in xmp(pair[1].encode()).items():
                        tags.setdefault(k, v)
                else:
                    tags.setdefault(*pair)
    elif raw[:4] == b"GIF8" and len(raw) >= 10:
        tags["ImageWidth"], tags["ImageHeight"] = map(str, struct.unpack_from("<HH", raw, 6))
    return tags, thumb


def png_pixels(raw: bytes, most: int = 64 << 20) -> np.ndarray | None:
    """(height, width, channels) of a PNG of 8-bit samples without interlace; None for any other."""
    if raw[:8] != PNG:
        return None
    head, packed = b"", []
    for kind, data in png_chunks(raw):
        if kind == b"IHDR":
            head = data
        elif kind == b"IDAT":
            packed.append(data)
    if len(head) < 13:
        return None
    w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", head)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    row = w * (channels or 0)
    if depth != 8 or interlace or not row or (row + 1) * h > most:
        return None
    try:
        data = zlib.decompressobj().decompress(b"".join(packed), (row + 1) * h)
    except zlib.error:
        return None
    if len(data) < (row + 1) * h:
        return None
    lines = np.frombuffer(data, np.uint8).reshape(h, row + 1)
    out, above = np.zeros((h, row), np.uint8), np.zeros(row, np.uint8)
    for y in range(h):
        kind, line = lines[y, 0], lines[y, 1:]
        if kind == 0:
            above = line
        elif kind == 1:
            above = np.cumsum(line.reshape(w, channels), 0, dtype=np.uint8).ravel()
        elif kind == 2:
            above = line + above
        elif kind in (3, 4):
            above = _predicted(line.tolist(), above.tolist(), channels, kind == 4)
        else:
            return None
        out[y] = above
    return out.reshape(h, w, channels)


def _predicted(line: list[int], above: list[int], step: int, paeth: bool) -> np.ndarray:
    """A line whose bytes were stored as differences from the average, or the nearest, of their neighbours."""
    out = [0] * len(line)
    for i, x in enumerate(line):
        left, up = out[i - step] if i >= step else 0, above[i]
        if paeth:
            corner = above[i - step] if i >= step else 0
            guess = left + up - corner
            a, b, c = abs(guess - left), abs(guess - up), abs(guess - corner)
            near = left if a <= b and a <= c else up if b <= c else corner
        else:
            near = (left + up) >> 1
        out[i] = (x + near) & 255
    return np.array(out, np.uint8)


def gray8(pixels: np.ndarray) -> list[int]:
    """64 gray values, means of the fields of an 8 x 8 grid."""
    g = pixels[..., :3].astype(float) @ np.array([0.299, 0.587, 0.114]) if pixels.shape[2] >= 3 else pixels[..., 0].astype(float)
    ys, xs = (np.linspace(0, n, 9).astype(int) for n in g.shape)
    return [int(round(g[a : max(b, a + 1), c : max(d, c + 1)].mean())) for a, b in zip(ys, ys[1:], strict=False) for c, d in zip(xs, xs[1:], strict=False)]


def decoded(raw: bytes) -> np.ndarray | None:
    """Pixels of a PNG by the reader here, of other formats by Pillow where it is installed."""
    if raw[:8] == PNG:
        return png_pixels(raw)
    try:
        from PIL import Image
    except ImportError:
        return None
    import io

    try:
        with Image.open(io.BytesIO(raw)) as picture_:
            return np.asarray(picture_.convert("RGB"))
    except Exception:  # noqa: BLE001 what cannot be decoded has no pixels
        return None


def thumbnail_of(raw: bytes) -> tuple[float, float, list[int] | None, list[int] | None] | None:
    """(aspect, aspect of the thumbnail, their grays if both decode) of a picture with a thumbnail."""
    tags, thumb = picture(raw)
    if not thumb:
        return None
    small, _ = picture(thumb)
    try:
        a = float(tags.get("ImageWidth") or tags["ExifImageWidth"]) / float(tags.get("ImageHeight") or tags["ExifImageHeight"])
        b = float(small["ImageWidth"]) / float(small["ImageHeight"])
    except (KeyError, ValueError, ZeroDivisionError):
        return None
    main, other = decoded(raw), decoded(thumb)
    both = main is not None and other is not None
    return a, b, gray8(main) if both else None, gray8(other) if both else None

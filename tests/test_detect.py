import io
import struct
import tarfile
import zipfile

import pytest

from docsignal.operators import detect, metadata, uniqueness
from docsignal.queries import make_jpeg, make_pdf, make_png, make_zip
from docsignal.sources import containers
from docsignal.sources.files import classify

MARK = "/QXUGUTA" + "ENT"
U = "https://tracker.test/pixel.gif?d=c"


def table(spark, files):
    import hashlib

    rows = [(p, hashlib.sha256(c).hexdigest(), len(c), None, bytearray(c)) for p, c in files.items()]
    return classify(spark.createDataFrame(rows, "path string, sha256 string, size long, mtime timestamp, content binary"))


def found(spark, files, **kw):
    return {(r.file, r.category, r.subcategory, r.evidence, r.severity) for r in detect.remote_references(table(spark, files), **kw).collect()}


def kinds(spark, name, content):
    return {(c, s) for _, c, s, _, _ in found(spark, {name: content})}


@pytest.mark.parametrize(("path", "content", "want"), [("a/x.PDF", b"", "pdf"), ("x.tar.gz", b"", "archive"), (".hidden", b"%PDF-1", "pdf"), ("x.", b"{\\rtf1", "rtf"), ("n", b"PK\3\4", "archive"), ("n", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "ole"), ("n", b"\x1f\x8b", "archive"), ("n", b"<?xml ?>", "xml"), ("n", b" <html>", "html"), ("n", b"zz", "other"), ("x.mp3", b"", "other"), ("x.docx", b"%PDF", "ooxml")])
def test_bucket(spark, path, content, want):
    assert table(spark, {path: content}).first().bucket == want


def test_specialized(spark):
    df = classify(table(spark, {"x.mp3": b"", "y.pdf": b""}).drop("bucket", "mime", "extension"), specialized=True)
    assert {r.path: r.bucket for r in df.collect()} == {"x.mp3": "specialized", "y.pdf": "pdf"}


def test_html(spark):
    got = kinds(spark, "x.html", f'<img src="{U}" width="1"><script src="https://h/s.js"></script><iframe src="https://h/i"><a ping="x" href="https://h/a">ftp://h/f \\\\srv\\share'.encode())
    assert {("tracking_pixel", "img_beacon"), ("javascript", "script_src"), ("active_url", "iframe"), ("active_url", "a"), ("active_url", "ftp"), ("active_url", "unc_path"), ("tracking_pixel", "ping")} == got


def test_rtf(spark):
    assert kinds(spark, "x.rtf", f"{{\\rtf1 {{\\object\\objemb{{\\*\\objdata 01}}}}\\objupdate {U} }}".encode()) == {("embedded_object", "objdata"), ("active_url", "hyperlink"), ("embedded_object", "objhtml")}


def test_vendor_token_in_pdf_stream(spark):
    got = found(spark, {"x.pdf": make_pdf("https://h/about" + MARK)})
    assert [x for x in got if x[2] == "thinkst_canarytoken"] == [("x.pdf", "active_url", "thinkst_canarytoken", "https://h/about/", "critical")]


def test_pdf(spark):
    body = b"%PDF-1.4\n1 0 obj\n<</Type/Catalog/AcroForm 3 0 R/OCProperties<</D 1>>/Open#41ction<</S/JavaScript/JS(app.launchURL)>>>>\nendobj\n3 0 obj\n<</FT/Sig/T(a\\)b)/TU(https://h/t)/V(v)>>\nendobj\ntrailer\n<</Encrypt 4 0 R>>\n%%EOF\n%%EOF\n"
    got = kinds(spark, "x.pdf", body)
    for want in (("incremental_update", "pdf_incremental"), ("encrypted_file", "pdf_encrypt"), ("javascript", "/JS"), ("javascript", "/JavaScript"), ("open_action", "/OpenAction"), ("form_field", "pdf_form"), ("watermark", "pdf_ocg"), ("suspicious_metadata_field", "pdf_signature")):
        assert want in got
    assert ("active_url", "/Launch") not in got
    assert ("active_url", "/Launch") in {(c, s) for _, c, s, _, _ in found(spark, {"x.pdf": body}, compat=True)}
    assert containers.form_fields(body) == [{"obj": "3 0", "ft": "/Sig", "t": "a)b", "tu": "https://h/t", "v": "v"}]
    assert containers.pdf_keywords(b"no") == {}


def test_ooxml(spark):
    doc = make_zip({"word/_rels/document.xml.rels": b'TargetMode="External" https://h/r', "word/document.xml": b"DDEAUTO c:\\x", "word/header1.xml": b"https://h/h", "customXml/a.xml": b"https://h/c", "word/theme/t.xml": b"https://h/z", "docProps/core.xml": b"<dc:creator>me</dc:creator><cp:lastModifiedBy>you</cp:lastModifiedBy><cp:lastPrinted>t</cp:lastPrinted>", "word/printerSettings1.bin": b"", "word/embeddings/oleObject1.bin": b"x", "word/vbaProject.bin": b"x"})
    got = kinds(spark, "x.docx", doc)
    assert {("active_url", "external_rel"), ("javascript", "dde_link"), ("active_url", "header1.xml"), ("active_url", "customxml"), ("active_url", "zip_member_t.xml"), ("metadata_pii", "ooxml_creator"), ("metadata_pii", "ooxml_last_modifier"), ("metadata_pii", "ooxml_last_printed"), ("suspicious_metadata_field", "ooxml_printer_settings"), ("embedded_object", "oleObject1.bin"), ("javascript", "vba")} == got
    emb = detect.embedded(table(spark, {"x.docx": doc})).collect()
    assert sorted(r.subcategory for r in emb) == ["oleObject1.bin", "vbaProject.bin"] and all(len(r.extras["sha256"]) == 64 for r in emb)


def encrypted_zip():
    raw = bytearray(make_zip({"secret.txt": b"x"}))
    raw[6] |= 1
    raw[raw.index(b"PK\1\2") + 8] |= 1
    return bytes(raw)


def test_encrypted(spark):
    assert kinds(spark, "x.docx", encrypted_zip()) == {("encrypted_file", "zip_encrypt")}
    assert kinds(spark, "x.zip", encrypted_zip()) == {("encrypted_file", "zip_encrypt")}


def test_odf_mail_svg_csv_xml(spark):
    assert kinds(spark, "x.odt", make_zip({"content.xml": b"https://h/c", "other.xml": b"https://h/o"})) == {("active_url", "content.xml")}
    mail = f'X-Mailer: https://h/m\nReceived: by https://h/r\nDisposition-Notification-To: me@h\nContent-Type: text/html\n\n<img src="{U}" width="1"> https://h/i'.encode()
    assert kinds(spark, "x.eml", mail) == {("suspicious_metadata_field", "email_header/x_mailer"), ("suspicious_metadata_field", "email_header/received"), ("read_receipt", "disposition_notification"), ("tracking_pixel", "eml_beacon"), ("active_url", "eml_img")}
    mht = b'Content-Location: https://h/top\nMIME-Version: 1.0\nContent-Type: multipart/related; boundary="b"\n\n--b\nContent-Type: text/html\nContent-Location: https://h/part\n\nhttps://h/body\n--b--\n'
    assert {s for _, s in kinds(spark, "x.mht", mht)} == {"header_content_location", "part_content_location", "part_body"}
    assert kinds(spark, "x.svg", b'<svg><image href="https://h/i"/><script href="ftp://h/s"/></svg>') == {("active_url", "svg_href"), ("javascript", "svg_script")}
    assert kinds(spark, "x.svg", b'<!DOCTYPE s [<!ENTITY a "b">]><svg href="https://h/i"/>') == set()
    assert kinds(spark, "x.csv", b'name,value\nx,"=HYPERLINK(""https://h/c"",""k"")"\n=SUM(1),-1') == {("formula_injection", "csv_formula"), ("active_url", "csv_formula_url")}
    assert kinds(spark, "x.xml", b'<!DOCTYPE r [<!ENTITY x SYSTEM "https://h/x">]><r a="document(\'https://h/d\')"/>') == {("external_entity", "xxe")}
    assert kinds(spark, "x.xsl", b"<r a=\"document('https://h/d')\"/>") == {("external_entity", "xslt_document")}


def compound(streams):
    """A compound file of 512-byte sectors, with every stream padded to the size at which it has sectors of its own."""
    from docsignal.sources.compound import MAGIC

    entry = lambda name, kind, right, child, start, size: name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB3I", 2 * len(name) + 2, kind, 1, 0xFFFFFFFF, right, child) + b"\0" * 36 + struct.pack("<IQ", start, size)
    fat, body, entries = [0xFFFFFFFD, 0xFFFFFFFE], b"", [entry("Root Entry", 5, 0xFFFFFFFF, 1, 0xFFFFFFFE, 0)]
    names = list(streams)
    for k, name in enumerate(names):
        data = streams[name].ljust(4096, b" ")
        start, n = len(fat), -(-len(data) // 512)
        fat += [*range(start + 1, start + n), 0xFFFFFFFE]
        body += data.ljust(n * 512, b"\0")
        entries.append(entry(name, 2, k + 2 if k + 1 < len(names) else 0xFFFFFFFF, 0xFFFFFFFF, start, len(data)))
    assert len(fat) <= 128 and len(entries) <= 4
    head = MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<8I", 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    return head + struct.pack("<128I", *fat, *[0xFFFFFFFF] * (128 - len(fat))) + b"".join(entries).ljust(512, b"\0") + body


def test_macro_source():
    from docsignal.sources.compound import expand_macro

    # the worked examples of the public description
    assert expand_macro(bytes.fromhex("0119b000616263646566676800696a6b6c6d6e6f700071727374757630")[:29]).startswith(b"abcdefgh")
    assert expand_macro(bytes.fromhex("0103b002614500")) == b"a" * 73


def test_ole_and_lnk(spark):
    literal = b"Attribute VB_Name\r\nx = Environ(1) WScript.Network https://h/v"
    chunk = b"".join(b"\0" + literal[i : i + 8] for i in range(0, len(literal), 8))
    macro = b"\1" + struct.pack("<H", 0xB000 | (len(chunk) - 1)) + chunk
    ole = compound({"Module": b"head" + macro, "Ole10Native": b"x", "Wide": "\ufeffhttps://h/wide".encode("utf-16-le")})
    got = kinds(spark, "x.doc", ole)
    assert {("javascript", "vba"), ("active_url", "vba_url"), ("javascript", "macro_fingerprint"), ("embedded_object", "ole_embedded"), ("active_url", "ole_stream/Wide")} <= got
    assert [r.subcategory for r in detect.embedded(table(spark, {"x.doc": ole})).collect()] == ["ole_stream"]
    msg = compound({"__substg1.0_10130102": b"<html>https://h/body ", "__substg1.0_007D001F": "X-Mailer: https://h/m\r\nSubject: https://h/s\r\n".encode("utf-16-le")})
    got = found(spark, {"x.msg": msg})
    assert ("x.msg", "tracking_pixel", "msg_html_url", "https://h/body", "critical") in got and ("x.msg", "suspicious_metadata_field", "email_header/x_mailer", "https://h/m", "info") in got
    assert kinds(spark, "y.doc", b"plain https://h/p") == {("active_url", "hyperlink")}
    tail = b"\0"
    info = struct.pack("<7I", 28 + 20 + 14 + 1, 28, 2, 0, 0, 28, 28 + 20 + 14) + struct.pack("<5I", 34, 0, 20, 0, 0) + b"\\\\srv\\share\0".ljust(14, b"\0") + tail
    lnk = struct.pack("<I", 76) + b"\0" * 16 + struct.pack("<I", 2) + b"\0" * 52 + info
    assert found(spark, {"x.lnk": lnk}) == {("x.lnk", "active_url", "unc_path", "\\\\srv\\share", "critical")}


def test_png(spark):
    ok, more = make_png(U), make_png("t", b"extra")
    assert [r.subcategory for r in detect.stego(table(spark, {"a.png": ok, "b.png": more, "c.png": ok[:-6]})).orderBy("file").collect()] == ["pngcheck", "pngcheck"]
    assert ("active_url", "comment") in kinds(spark, "a.png", ok)


def test_archive_depth(spark):
    inner = make_zip({"d.html": f'<a href="{U}">'.encode()})
    for _ in range(3):
        inner = make_zip({"n.zip": inner})
    got = {f for f, c, *_ in found(spark, {"o.zip": inner}) if c == "archive_nested"}
    assert got == {"o.zip", "o.zip!/n.zip", "o.zip!/n.zip!/n.zip", "o.zip!/n.zip!/n.zip!/n.zip"}
    assert not any(c == "active_url" for _, c, *_ in found(spark, {"o.zip": inner}))  # listed, not opened
    assert any(f == "o.zip!/n.zip!/n.zip!/n.zip!/d.html" for f, *_ in found(spark, {"o.zip": inner}, max_depth=4))


def test_safe_members():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in ("safe.txt", "../unsafe.txt", "sub/../../unsafe.txt", "sub/ok.txt"):
            z.writestr(n, "x")
    assert [n for n, _ in containers.members(out.getvalue(), "a.zip")] == ["safe.txt", "sub/ok.txt"]
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for n in ("safe.txt", "../unsafe.txt", "/abs.txt"):
            i = tarfile.TarInfo(n)
            i.size = 1
            t.addfile(i, io.BytesIO(b"x"))
    assert containers.members(out.getvalue(), "a.tgz") == [("safe.txt", b"x")]


def test_broken_files_give_info_or_nothing(spark):
    got = found(spark, {"a.zip": b"PK\3\4broken", "b.docx": b"junk", "c.7z": b"7z", "d.eml": b"", "e.html": b"", "f.pdf": b""})
    assert {(f, c) for f, c, *_ in got} == {("a.zip", "no_bucket_check"), ("b.docx", "no_bucket_check"), ("c.7z", "no_bucket_check")}


def test_metadata(spark):
    pdf = b"%PDF-1\n1 0 obj\n<</Type/Page/Author(me)/Producer(https://h/p)>>\nendobj\n2 0 obj\n<</FT/Tx/T(f)/TU(https://h/tip)>>\nendobj\n"
    f = table(spark, {"x.pdf": pdf, "y.png": make_png("c")})
    meta = metadata.metadata(f)
    m = {r.path: r for r in meta.collect()}
    assert all(r.error is None for r in m.values())
    assert m["x.pdf"].tags == {"Author": "me", "Producer": "https://h/p", "PageCount": "1"} and m["y.png"].tags["ImageWidth"] == "1"
    got = {(r.file, r.category, r.subcategory) for r in metadata.metadata_findings(f, meta).collect()}
    assert got == {("x.pdf", "metadata_pii", "author"), ("x.pdf", "active_url", "producer"), ("x.pdf", "active_url", "pdf_form_tooltip"), ("x.pdf", "form_field", "pdf_form"), ("y.png", "metadata_pii", "comment")}


def test_uniqueness(spark):
    field = lambda v: b"%PDF-1\n1 0 obj\n<</FT/Tx/T(f)/V(" + v + b")>>\nendobj\n"
    core = lambda g: make_zip({"docProps/core.xml": b"<cp:revision>1</cp:revision><guid>" + g + b"</guid>"})
    f = table(spark, {"a.pdf": field(b"one"), "b.pdf": field(b"two"), "a.rtf": b"x \r\ny", "b.rtf": "\ufeffx\ny\n".encode(), "a.docx": core(b"1"), "b.docx": core(b"2"), "solo.doc": b"x"})
    got = {(r.file, r.subcategory) for r in uniqueness.uniqueness(f, metadata.metadata(f)).collect()}
    assert got == {(p, s) for ext, subs in ((".pdf", ["pdf_form_field", "pdf_normalized_bytes"]), (".rtf", ["canonicalization_diff"]), (".docx", ["core_xml_guid_revision"])) for p in ("a" + ext, "b" + ext) for s in subs}
    same = table(spark, {"a.docx": core(b"1"), "b.docx": core(b"1")})
    assert uniqueness.uniqueness(same, metadata.metadata(same)).count() == 0


def test_archive_members_over_the_document_limit():
    """20 MiB is the limit of OOXML and ODF members; ordinary archives are unpacked beyond it, documents tell what they skip."""
    out, big = io.BytesIO(), b"%PDF" + b"a" * (20 << 20)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("big.pdf", big)
    assert [(p, data == big) for p, data, _ in containers.expand(out.getvalue(), "a.zip")] == [("a.zip!/big.pdf", True)]
    assert [(k, n) for k, n, _, _ in containers.zip_parts(out.getvalue(), "a.docx")] == [("skipped", "big.pdf")]


def test_many_cells(spark):
    """Places of findings are long: a file with more cells than 32-bit places could number."""
    cells = "\n".join(["-1"] * 30_000 + ['"=HYPERLINK(""https://h/c"")"']).encode()
    rows = detect.remote_references(table(spark, {"x.csv": cells})).select("category", "seq").collect()
    assert {r.category for r in rows} == {"formula_injection", "active_url"} and {r.seq.part for r in rows} == {30_000}


def test_unread_content_gives_rows(spark):
    """Content that is missing is told by every stage, and makes no difference between files."""
    rows = [(p, "0" * 64, 5, None, None) for p in ("a.pdf", "b.csv", "c.html", "d.docx", "e.png", "f.rtf")]
    f = classify(spark.createDataFrame(rows, "path string, sha256 string, size long, mtime timestamp, content binary"))
    got = {(r.file, r.category) for r in detect.remote_references(f).collect()}
    assert got == {(p, "no_bucket_check") for p in ("a.pdf", "b.csv", "c.html", "d.docx", "e.png", "f.rtf")}
    meta = metadata.metadata(f)
    assert {(r.file, r.category) for r in metadata.metadata_findings(f, meta).collect()} == {(p, "no_bucket_check") for p in ("a.pdf", "d.docx", "e.png")}
    assert {(r.file, r.category) for r in detect.stego(f).collect()} == {("e.png", "no_bucket_check")}


def test_broken_members_of_clusters(spark):
    """An unreadable copy is told and does not count as different."""
    core = make_zip({"docProps/core.xml": b"<cp:revision>1</cp:revision>"})
    f = table(spark, {"a.docx": core, "b.docx": core, "c.docx": b"PK\3\4broken"})
    meta = metadata.metadata(f)
    assert {r.path for r in meta.where("error is not null").collect()} == {"c.docx"}
    same = meta.withColumn("tags", metadata.F.create_map().cast("map<string,string>"))
    got = {(r.file, r.category) for r in uniqueness.uniqueness(f, same).collect()}
    assert got == {("c.docx", "no_bucket_check")}


def test_archive_budget(spark, monkeypatch):
    """What an archive may unpack to is bounded over all its levels; the rest is told."""
    inner = make_zip({f"{k}.html": b'<a href="https://h/%d">' % k + b" " * 5000 for k in range(6)})
    monkeypatch.setattr(containers, "MAX_UNPACKED", 60_000)
    raw = make_zip({"n.zip": inner, "z.html": b"x" * 100_000})
    out = list(containers.expand(raw, "o.zip"))
    assert [p for p, d, _ in out if d is None] == ["o.zip!/n.zip!/5.html", "o.zip!/z.html"] and sum(len(d) for _, d, _ in out if d) <= 60_000
    rows = [(p, "", 1, None, None if d is None else bytearray(d)) for p, d, _ in out]
    told = detect.remote_references(classify(spark.createDataFrame(rows, "path string, sha256 string, size long, mtime timestamp, content binary"))).where("category = 'no_bucket_check'")
    assert {r.file for r in told.collect()} == {"o.zip!/n.zip!/5.html", "o.zip!/z.html"}


def test_inflate_is_bounded():
    import zlib

    assert len(containers.inflate(zlib.compress(b"0" * (1 << 20)), 1000)) == 1000


def test_pictures(spark):
    from docsignal.sources import pictures

    jpeg = make_jpeg({0x010E: "see https://h/d", 0x013B: "Ann", 0xA431: "x"}, (640, 480), make_jpeg({}, (160, 120)))
    tags, thumb = pictures.picture(jpeg)
    assert tags["Artist"] == "Ann" and (tags["ImageWidth"], tags["ImageHeight"]) == ("640", "480") and pictures.picture(thumb)[0]["ImageWidth"] == "160"
    assert ("active_url", "imagedescription") in kinds(spark, "a.jpg", jpeg)
    gps = struct.pack("<H", 4) + struct.pack("<HHI4s", 1, 2, 2, b"S\0") + struct.pack("<HHII", 2, 5, 3, 100) + struct.pack("<HHI4s", 3, 2, 2, b"E\0") + struct.pack("<HHII", 4, 5, 3, 124) + struct.pack("<I", 0)
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x8825, 4, 1, 26) + struct.pack("<I", 0) + gps
    tiff = tiff.ljust(100, b"\0") + struct.pack("<6I", 10, 1, 30, 1, 0, 1) + struct.pack("<6I", 20, 1, 0, 1, 36, 1)
    assert pictures.exif(tiff)[0]["GPSPosition"] == "-10.5 20.01"
    assert pictures.xmp(b'<x xmpMM:DocumentID="uuid:1" dc:format="a/b"><dc:creator><rdf:Seq><rdf:li>Bob</rdf:li></rdf:Seq></dc:creator><xmp:Label>L</xmp:Label></x>') == {"DocumentID": "uuid:1", "format": "a/b", "creator": "Bob", "Label": "L"}
    import zlib

    for kind, data in ((b"zTXt", b"K\0\0" + zlib.compress(b"v")), (b"iTXt", b"K\0\1\0en\0\0" + zlib.compress("é".encode())), (b"iTXt", "K\0\0\0\0\0é".encode())):
        assert pictures.png_text(kind, data) in (("K", "v"), ("K", "é"))
    for broken in (b"", b"\xff\xd8\xff", jpeg[:40], b"II*\0" + b"\xff" * 30, b"\x89PNG\r\n\x1a\n\0"):
        pictures.picture(broken)


def test_thumbnail_unlike_its_picture(spark):
    like, unlike = make_jpeg({}, (640, 480), make_jpeg({}, (160, 120))), make_jpeg({}, (640, 480), make_jpeg({}, (160, 60)))
    rows = detect.stego(table(spark, {"a.jpg": like, "b.jpg": unlike})).collect()
    assert [(r.file, r.subcategory, r.evidence) for r in rows] == [("b.jpg", "thumbnail_mismatch", "aspect 1.33, of the thumbnail 2.67")]


def coloured(pixels, kinds=(0, 1, 2, 3, 4)):
    """A PNG of (height, width, 3) bytes whose lines use the given filters in turn."""
    import zlib

    import numpy as np

    h, w, c = pixels.shape
    raw, above = b"", np.zeros(w * c, int)
    for y in range(h):
        line, kind = pixels[y].ravel().astype(int), kinds[y % len(kinds)]
        left = np.concatenate([np.zeros(c, int), line[:-c]])
        corner = np.concatenate([np.zeros(c, int), above[:-c]])
        p = left + above - corner
        a, b, d = abs(p - left), abs(p - above), abs(p - corner)
        paeth = np.where((a <= b) & (a <= d), left, np.where(b <= d, above, corner))
        guess = [0 * line, left, above, (left + above) // 2, paeth][kind]
        raw += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        above = line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_pixels_of_clusters(spark):
    import numpy as np

    from docsignal.sources import pictures

    a = np.random.default_rng(0).integers(0, 256, (23, 17, 3)).astype(np.uint8)
    b = a.copy()
    b[3, 4] ^= 1
    b[9, 1] ^= 128
    assert (pictures.png_pixels(coloured(a)) == a).all()
    assert len(pictures.gray8(a)) == 64 and pictures.png_pixels(coloured(a)[:60]) is None
    f = table(spark, {"a.png": coloured(a), "b.png": coloured(b, (2,)), "c.png": coloured(a)})
    got = {(r.file, r.subcategory, r.evidence) for r in uniqueness.uniqueness(f, metadata.metadata(f)).collect()}
    assert got == {(p, "pixel_diff", "2") for p in ("a.png", "b.png", "c.png")}


def test_evidence_is_bounded(spark):
    """Of many values a cluster names some and counts the rest."""
    rows = [("c", {"DocumentID": f"{k:05}"}) for k in range(500)] + [("d", {"DocumentID": x}) for x in "ba"]
    got = {r.cluster_id: r.evidence for r in uniqueness.tag_diffs(spark.createDataFrame(rows, "cluster_id string, tags map<string,string>")).collect()}
    assert got["d"] == "a, b" and got["c"].endswith("00019, and 480 more")


def test_objects_are_written(spark, tmp_path):
    doc = make_zip({"word/embeddings/oleObject1.bin": b"payload"})
    (row,) = detect.embedded(table(spark, {"x.docx": doc}), extract=f"file://{tmp_path}").collect()
    from pathlib import Path

    assert Path(row.extras["extracted_path"].removeprefix("file://")).read_bytes() == b"payload" and row.extras["size"] == "7"


def make_7z(files, method="lzma2", packed_header=False):
    """A 7z archive of one solid folder; files with no content are listed as empty."""
    import lzma
    import zlib

    def number(n):
        return bytes([n]) if n < 0x80 else b"\xff" + struct.pack("<Q", n)

    full = {k: v for k, v in files.items() if v}
    plain = b"".join(full.values())
    props = bytes([16])
    name, data = {"copy": (b"\0", plain), "deflate": (b"\4\1\x08", zlib.compress(plain)[2:-4]), "lzma2": (b"\x21", lzma.compress(plain, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 19}])), "aes": (b"\x06\xf1\x07\x01", plain)}[method]
    coder = bytes([len(name) | (0x20 if method == "lzma2" else 0)]) + name + (number(1) + props if method == "lzma2" else b"")

    def streams(at, size, coder, whole, pieces):
        sub = b"\x08\x0d" + number(len(pieces)) + b"\x09" + b"".join(map(number, pieces[:-1])) + b"\0" if pieces else b""
        return b"\x06" + number(at) + number(1) + b"\x09" + number(size) + b"\0\x07\x0b" + number(1) + b"\0" + number(1) + coder + b"\x0c" + number(whole) + b"\0" + sub + b"\0"

    bits = "".join("0" if v else "1" for v in files.values()).ljust(8, "0")
    listed = "".join(k + "\0" for k in files).encode("utf-16-le")
    header = b"\1\4" + streams(0, len(data), coder, len(plain), [len(v) for v in full.values()]) + b"\5" + number(len(files)) + b"\x0e" + number(1) + bytes([int(bits, 2)]) + b"\x11" + number(len(listed) + 1) + b"\0" + listed + b"\0\0"
    body = data
    if packed_header:
        small = lzma.compress(header, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "lc": 3, "lp": 0, "pb": 2, "dict_size": 1 << 16}])
        inner = b"\x23\3\1\1" + number(5) + bytes([93]) + struct.pack("<I", 1 << 16)
        header, body = b"\x17" + streams(len(data), len(small), inner, len(header), []), data + small
    start = struct.pack("<QQI", len(body), len(header), zlib.crc32(header))
    return b"7z\xbc\xaf\x27\x1c\0\4" + struct.pack("<I", zlib.crc32(start)) + start + body + header


@pytest.mark.parametrize("method", ["copy", "deflate", "lzma2"])
def test_7z(spark, method):
    files = {"a.html": f'<a href="{U}">'.encode(), "dir": b"", "../x.html": b"unsafe", "n.zip": make_zip({"b.html": b'<a href="https://h/b">'})}
    for packed in (False, True):
        raw = make_7z(files, method, packed)
        assert containers.members(raw, "o.7z") == [("a.html", files["a.html"]), ("n.zip", files["n.zip"])]
        assert containers.names(raw, "o.7z") == list(files)
    got = found(spark, {"o.7z": raw, "unnamed": raw, "p.gz": __import__("gzip").compress(b"<html><a href='https://h/g'>"), "q.html.gz": __import__("gzip").compress(b"<a href='https://h/q'>")})
    assert {(f, c) for f, c, *_ in got if c != "archive_nested"} == {("o.7z!/a.html", "active_url"), ("o.7z!/n.zip!/b.html", "active_url"), ("unnamed!/a.html", "active_url"), ("unnamed!/n.zip!/b.html", "active_url"), ("p.gz!/p", "active_url"), ("q.html.gz!/q.html", "active_url")}


def test_7z_that_is_locked_or_broken(spark):
    raw = make_7z({"a.html": b"x"}, "lzma2")
    for cut in range(0, len(raw), 7):  # no cut may end the stage
        try:
            containers.members(raw[:cut], "o.7z")
        except Exception as e:
            assert not isinstance(e, (MemoryError, RecursionError))
    assert [p[:2] for p in containers.archive_parts(make_7z({"a": b"x"}, "aes"), "o.7z", 0)] == [("archive_encrypt", "a")]
    with pytest.raises(ValueError, match="password"):
        containers.members(make_7z({"a": b"x"}, "aes"), "o.7z")

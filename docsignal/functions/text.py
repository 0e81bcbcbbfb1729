"""Text functions as Column expressions: links, domains, tags, canonical forms. All run inside generated code, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import hit, none, when
from ..vocab import VENDOR_TOKEN

# (?U): \s and \w cover Unicode
URL = r"""(?U)(?i)https?://[^\s"'<>]+"""
FTP = r"""(?U)(?i)ftp://[^\s"'<>]+"""
UNC = r"""(?U)\\\\[\w.-]+\\[\w.-]+"""
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"


def find_all(text: Column, pattern: str) -> Column:
    """All matches in order; null text has none. The quick test spares most rows the search."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def urls(text: Column) -> Column:
    return find_all(text, URL)


def ftps(text: Column) -> Column:
    return find_all(text, FTP)


def uncs(text: Column) -> Column:
    return find_all(text, UNC)


def ips(text: Column) -> Column:
    return find_all(text, IPV4)


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def has_token(url: Column) -> Column:
    return F.instr(_trimmed(url), VENDOR_TOKEN) > 0


def _trimmed(url: Column) -> Column:
    out = strip(url)
    for c in ")><\"'":
        out = F.btrim(out, F.lit(c))
    return out


def clean_url(url: Column) -> Column:
    """The link without wrapping marks; up to a vendor token, with a closing slash."""
    x = _trimmed(url)
    at = F.instr(x, VENDOR_TOKEN)
    head = strip(F.substring(x, F.lit(1), at - 1))
    return F.when(at > 0, F.when(head.endswith("/"), head).otherwise(F.concat(head, F.lit("/")))).otherwise(x)


def domain(evidence: Column, strict_host: bool = False) -> Column:
    """The domain that an address is counted under: lower case, cut at the first colon; ftp and UNC addresses keep their path.

    strict_host gives the bare host of any of them instead.
    """
    lower = F.lower(evidence)
    x = F.when(lower.startswith("ftp://"), F.substring(evidence, 7, 2**31 - 1)).when(evidence.startswith("\\\\"), F.replace(F.substring(evidence, 3, 2**31 - 1), F.lit("\\"), F.lit("/"))).otherwise(evidence)
    if strict_host:
        host = F.regexp_extract(x, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
        return F.lower(host)
    x = F.regexp_replace(x, r"[\t\r\n]", "")
    parts = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?([^?#]*)"
    net, path = F.regexp_extract(x, parts, 1), F.regexp_replace(F.regexp_extract(x, parts, 2), ";[^/]*$", "")
    broken = F.contains(net, F.lit("[")) != F.contains(net, F.lit("]"))
    return F.when(broken, lower).otherwise(F.lower(F.substring_index(F.when(net != "", net).otherwise(path), ":", 1)))


def suffixes(dom: Column) -> Column:
    """The domain and every ending of it after a dot: a.b.c gives a.b.c, b.c, c; none for an empty domain."""
    p = F.split(dom, "\\.")
    return F.when(dom == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), ".")))


def matches_domain(dom: Column, patterns: list[str]) -> Column:
    """Whether a pattern, or *.pattern, is the domain or one of its endings."""
    if not patterns:
        return F.lit(False)
    return F.arrays_overlap(suffixes(dom), F.array(*map(F.lit, sorted({p.removeprefix("*.") for p in patterns} | set(patterns)))))


def tag_of(raw: Column, url: Column) -> Column:
    """Lower-case name of the tag around the first place of the url; empty outside tags."""
    before = F.substring(raw, F.lit(1), F.instr(raw, url) - 1)
    last = F.when(F.contains(before, F.lit("<")), F.substring_index(before, "<", -1)).otherwise(F.lit(""))
    name = F.regexp_extract(F.substring_index(last, ">", 1), r"(?U)^\s*(\S+)", 1)
    return F.btrim(F.lower(name), F.lit("/"))


PIXEL_MARKS = ['width="1"', "width='1'", "width=1", 'height="1"', "height='1'", "height=1"]


def is_pixel(raw: Column, url: Column) -> Column:
    """Whether the first image tag with the url as its source has a side of one pixel (or one that begins with 1 if unquoted)."""
    quoted = F.regexp_replace(url, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    pattern = F.concat(F.lit(r"""(?U)(?i)<img[^>]*src\s*=\s*["']"""), quoted, F.lit("""["'][^>]*>"""))
    tag = F.lower(F.coalesce(F.regexp_substr(raw, pattern), F.lit("")))
    found = F.lit(False)
    for m in PIXEL_MARKS:
        found = found | F.contains(tag, F.lit(m))
    return found


def canonical(text: Column) -> Column:
    """Without byte order mark, line ends as \\n, no blanks at line ends, none around the whole."""
    x = F.regexp_replace(F.regexp_replace(text, "^﻿+", ""), r"\r\n?", "\n")
    return strip(F.regexp_replace(x, r"(?U)[^\S\n]+(?=\n|\z)", ""))


def without_versions(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)v?\d[\d.]+", ""))


def header_name(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("-"), F.lit("_"))


def text_of(content: Column, limit: int) -> Column:
    """Bytes as UTF-8 text with U+FFFD for what is not, line ends as \\n; empty beyond the limit."""
    return F.when(F.octet_length(content) <= limit, F.regexp_replace(F.make_valid_utf8(content.cast("string")), r"\r\n?", "\n")).otherwise(F.lit(""))


def scan_text(text: Column, bucket: Column, tool: str | Column, subcategory: str | Column, severity: str | Column, confidence: float, category: str = "active_url") -> Column:
    """Hits of a text: links and vendor links, then FTP addresses, then UNC paths."""
    big, sub = F.upper(bucket), subcategory if isinstance(subcategory, Column) else F.lit(subcategory)

    def link(u):
        c, token = clean_url(u), has_token(u)
        return F.when(token, hit("active_url", "thinkst_canarytoken", F.concat(F.lit("address of a decoy service: "), c), c, tool, "critical", 1.0)).otherwise(hit(category, sub, F.concat(big, F.lit(" refers to "), c), c, tool, severity, confidence))

    http = F.filter(F.transform(urls(text), link), lambda h: h["evidence"] != "")
    ftp = F.transform(ftps(text), lambda u: hit("active_url", F.concat(sub, F.lit("_ftp")), F.concat(big, F.lit(" refers to the file server "), u), u, tool, severity, confidence))
    unc = F.transform(uncs(text), lambda u: hit("active_url", "unc_path", F.concat(big, F.lit(" refers to the network share "), u), u, tool, "critical", 0.9))
    likely = F.contains(F.lower(text), F.lit("tp")) | F.contains(text, F.lit("\\\\"))  # no link of any kind without one of these
    return F.when(likely, F.concat(http, ftp, unc)).otherwise(none())


__all__ = ["canonical", "clean_url", "domain", "find_all", "ftps", "has_token", "header_name", "ips", "is_pixel", "matches_domain", "scan_text", "strip", "suffixes", "tag_of", "text_of", "uncs", "urls", "when", "without_versions"]

"""Metadata: tags of files, form fields, and the findings they give."""

from __future__ import annotations

import re
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ftps, uncs, urls
from ..schema import METADATA, findings, hit, info, none, when
from ..sources.batches import bounded, rows_of
from ..sources.containers import PICTURES, form_fields, held, pdf_objects, stream, unescape_names
from ..sources.pictures import picture
from ..vocab import PII_TAGS, SUSPICIOUS_TAGS, URL_TAGS

#: files whose tags are read
BUCKETS = ("pdf", "ooxml", "odf", "image")
#: document property -> tag; fixed values of public formats
OOXML_TAGS = {"creator": "Creator", "lastModifiedBy": "LastModifiedBy", "title": "Title", "subject": "Subject", "description": "Description", "keywords": "Keywords", "revision": "Revision", "Company": "Company", "Manager": "Manager", "Application": "Producer", "Pages": "Pages"}


def tags_of(bucket: str, extension: str, raw: bytes) -> tuple[dict[str, str], list[dict[str, str]]]:
    """Tags and form fields of one file, from the formats' own metadata."""
    tags: dict[str, str] = {}
    fields: list[dict[str, str]] = []
    if bucket == "pdf":
        plain = unescape_names(raw)
        for key in ("Title", "Author", "Subject", "Keywords", "Creator", "Producer"):
            m = re.search(rb"/" + key.encode() + rb"\s*\(((?:[^()\\]|\\.)*)\)", plain)
            if m:
                tags[key] = re.sub(rb"\\(.)", rb"\1", m[1]).decode("utf-8", "replace")
        pages = len([1 for _, body in pdf_objects(raw) if re.search(r"/Type\s*/Page\b(?!s)", body)])
        if pages:
            tags["PageCount"] = str(pages)
        for key in ("DocumentID", "InstanceID", "OriginalDocumentID"):
            m = re.search(rb"xmpMM:" + key.encode() + rb"(?:>|=\")([^<\"]+)", raw)
            if m:
                tags[key] = m[1].decode("utf-8", "replace")
        fields = form_fields(raw)
    elif bucket in ("ooxml", "odf"):
        with zipfile.ZipFile(stream(raw)) as z:
            for name in ("docProps/core.xml", "docProps/app.xml", "meta.xml"):
                if name in z.namelist():
                    body = z.read(name).decode("utf-8", "replace")
                    for k, v in re.findall(r"<(?:[\w-]+:)?(\w[\w-]*)[^>]*>([^<]+)</", body):
                        tags.setdefault(OOXML_TAGS.get(k, k), v)
    elif bucket == "image":
        tags = picture(raw)[0]
    return tags, fields


def _opened(bucket: str, extension: str, raw):
    """Bytes, or an open ZIP document; of other large files all, if they have a reader here."""
    if isinstance(raw, bytes) or raw is None or bucket in ("ooxml", "odf"):
        return raw or b""
    return raw.read() if bucket == "pdf" or extension in PICTURES else b""


def metadata(files: DataFrame, source: str | None = None) -> DataFrame:
    """(path, tags, form_fields, error) of classified files; a file that cannot be parsed has no tags, and says why."""

    def run(batches):
        for batch in batches:
            paths, tags, fields, errors = [], [], [], []
            for path, bucket, ext, raw in rows_of(batch):
                why = None
                try:
                    opened = held(raw, source, path)
                    t, f = tags_of(bucket, ext, _opened(bucket, ext, opened))
                    why = "content was not read" if opened is None else None
                except Exception as e:  # noqa: BLE001 one bad file must not end the stage
                    t, f, why = {}, [], str(e) or type(e).__name__
                paths.append(path)
                errors.append(why)
                tags.append(list(t.items()))
                fields.append([{k: x.get(k) for k in ("obj", "ft", "t", "tu", "v")} for x in f])
            s = pa.string()
            yield pa.RecordBatch.from_arrays([pa.array(paths, s), pa.array(tags, pa.map_(s, s)), pa.array(fields, pa.list_(pa.struct([(k, s) for k in ("obj", "ft", "t", "tu", "v")]))), pa.array(errors, s)], names=["path", "tags", "form_fields", "error"])

    return bounded(files.where(F.col("bucket").isin(*BUCKETS)).select("path", "bucket", "extension", "content")).mapInArrow(run, METADATA)


def bare(tag: Column) -> Column:
    """The tag without its group: XMP:Title is Title."""
    return F.regexp_replace(tag, "^[^:]*:", "")


def tag_hits(tag: Column, value: Column) -> Column:
    """Of one tag: personal data, identifiers, links."""
    key, low = bare(tag), F.lower(bare(tag))
    cut = F.substring(value, 1, 500)
    return F.concat(
        when(key.isin(PII_TAGS), hit("metadata_pii", low, F.concat(key, F.lit(" names a person, place or device")), cut, "tag-reader", "medium", 0.6)),
        when(key.isin(SUSPICIOUS_TAGS), hit("metadata_unique", low, F.concat(key, F.lit(" may have been given to this copy alone")), cut, "tag-reader", "medium", 0.7)),
        when(key.isin(URL_TAGS) & F.lower(value).rlike("https?://"), hit("active_url", low, F.concat(key, F.lit(" holds an address")), cut, "tag-reader", "high", 0.7)),
    )


def field_hits(fields: Column) -> Column:
    """Links in names, tooltips and values of form fields, and their count."""

    def of(f):
        def link(name, end, what):
            return lambda u: hit("active_url", f"pdf_form_{name}{end}", F.concat(F.lit(f"the {name} of a form field holds {what} "), u), u, "pdf-reader", "critical", 0.95)

        def kind(name, v):
            return F.concat(*[F.transform(find(v), link(name, end, what)) for find, end, what in ((urls, "", "the address"), (ftps, "_ftp", "the file server"), (uncs, "_unc", "the network share"))])

        return F.concat(kind("name", f["t"]), kind("tooltip", f["tu"]), kind("value", f["v"]))

    n = F.size(fields).cast("string")
    form = when(F.size(fields) > 0, hit("form_field", "pdf_form", F.concat(n, F.lit(" fields to fill in")), F.concat(F.lit("fields: "), n), "pdf-reader", "medium", 0.8))
    return F.when(F.size(fields) > 0, F.concat(F.flatten(F.transform(fields, of)), form)).otherwise(none())


def metadata_findings(files: DataFrame, meta: DataFrame) -> DataFrame:
    """Findings of the metadata table, joined to the file records by path."""
    m = meta.withColumnRenamed("path", "_p")
    rows = files.select("path", "sha256", "bucket", "extension").join(m, F.col("path") == F.col("_p"))
    entries = F.transform(F.array_sort(F.map_keys("tags")), lambda k: tag_hits(k, F.col("tags")[k]))
    error = when(F.col("error").isNotNull(), info("metadata", F.concat(F.lit("tags could not be read: "), F.col("error"))))
    return findings(rows, "metadata", 1, F.concat(field_hits(F.col("form_fields")), F.flatten(entries), error))

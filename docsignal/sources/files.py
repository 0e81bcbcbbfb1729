"""Recursive file source that also sees names beginning with a dot or underscore, and classification of what it reads."""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..vocab import EXTENSION_BUCKET, MAX_TEXT, SPECIALIZED_KIND

SCHEMA = "path string, sha256 string, size long, mtime timestamp, content binary"
CHUNK = 1 << 20


LISTED = "path string, folder boolean, size long, mtime timestamp"
RECORD = "path string, sha256 string, size long, mtime timestamp, content binary"
#: as many first bytes as describe() looks at
HEAD = 512


def _arrow(rows: list[tuple], kind: str) -> pa.RecordBatch:
    types = {"listed": [pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC")], "record": [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.binary()]}[kind]
    names = [f.split()[0] for f in (LISTED if kind == "listed" else RECORD).split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(types), types, strict=True)], names=names)


def _digest(fs, path: str, keep: int) -> tuple[str, bytes] | None:
    """(SHA-256, first `keep` bytes) of a file, read in chunks; None if it cannot be read."""
    digest, kept, size = hashlib.sha256(), [], 0
    try:
        with fs.open_input_stream(path) as f:
            while block := f.read(CHUNK):
                digest.update(block)
                if size < keep:
                    kept.append(block[: keep - size])
                size += len(block)
    except OSError:
        return None
    return digest.hexdigest(), b"".join(kept)


class Chunk(InputPartition):
    def __init__(self, files: list[tuple[str, int, float]]):
        self.files = files


class FileReader(DataSourceReader):
    def __init__(self, uri: str, limit: int, target: int):
        self.uri, self.limit, self.target = uri, limit, target

    def partitions(self) -> list[Chunk]:
        """Files by path, dealt so that a task reads about `target` bytes."""
        fs, base = pafs.FileSystem.from_uri(self.uri)
        infos = [i for i in fs.get_file_info(pafs.FileSelector(base, recursive=True)) if i.is_file] if fs.get_file_info(base).type == pafs.FileType.Directory else [fs.get_file_info(base)]
        out, part, size = [], [], 0
        for i in sorted(infos, key=lambda i: i.path):
            part.append((i.path, i.size or 0, i.mtime.timestamp() if i.mtime else 0.0))
            size += (i.size or 0) + 4096
            if size >= self.target:
                out.append(Chunk(part))
                part, size = [], 0
        return [*out, Chunk(part)] if part or not out else out

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        """Content is read in chunks for the hash and kept up to the limit; a file that cannot be read is left out."""
        fs, _ = pafs.FileSystem.from_uri(self.uri)
        for path, size, mtime in partition.files:
            if got := _digest(fs, path, self.limit if size <= self.limit else 0):
                yield _arrow([(path, got[0], size, datetime.fromtimestamp(mtime, timezone.utc), got[1] if size <= self.limit else None)], "record")


class FileSource(DataSource):
    """format("docsignal_files").load(uri): path, sha256, size, mtime, content (null beyond `limit` bytes). The driver lists the files; for
    large trees use listing() and hashed()."""

    @classmethod
    def name(cls) -> str:
        return "docsignal_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FileReader:
        return FileReader(self.options["path"], int(self.options.get("limit", MAX_TEXT)), int(self.options.get("target", 64 << 20)))


def read_files(spark: SparkSession, uri: str, limit: int = MAX_TEXT) -> DataFrame:
    spark.dataSource.register(FileSource)
    return spark.read.format("docsignal_files").option("limit", limit).load(uri)


def listing(spark: SparkSession, uri: str, save: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """(path, size, mtime) of all files below a URI. Folders are listed by tasks, one level of the tree a job; save(table, level) writes a
    level's table and reads it back, so nothing is gathered by the driver."""

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                top = folder or base
                infos = [fs.get_file_info(top)] if not folder and fs.get_file_info(top).is_file else fs.get_file_info(pafs.FileSelector(top))
                for k in range(0, len(infos), 10_000):
                    yield _arrow([(i.path, i.type == pafs.FileType.Directory, i.size, i.mtime) for i in infos[k : k + 10_000] if i.type in (pafs.FileType.Directory, pafs.FileType.File)], "listed")

    level, files, folders = 0, None, spark.createDataFrame([("",)], "path string")
    while True:
        found = save(folders.mapInArrow(run, LISTED), level)
        here = found.where("not folder").select("path", "size", "mtime")
        files = here if files is None else files.unionByName(here)
        folders = found.where("folder").select("path").repartition("path")
        if not folders.limit(1).count():
            return files
        level += 1


def hashed(listed: DataFrame, uri: str, target: int = 64 << 20) -> DataFrame:
    """(path, sha256, size, mtime, content) of listed files, content being their first HEAD bytes; tasks read about `target` bytes. A file
    that cannot be read is left out."""
    total = listed.agg(F.sum(F.col("size") + 4096)).first()[0] or 0

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            rows = []
            for path, size, mtime in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if got := _digest(fs, path, HEAD):
                    rows.append((path, got[0], size, mtime, got[1]))
            yield _arrow(rows, "record")

    return listed.select("path", "size", "mtime").repartition(max(1, -(-total // target))).mapInArrow(run, RECORD)


def with_content(files: DataFrame, uri: str, limit: int = MAX_TEXT, budget: int = 16 << 20) -> DataFrame:
    """File records with their content read again (null beyond `limit` or if the file is gone), in batches of about `budget` bytes. Only
    the rows that reach this are read, so filter by bucket before."""
    cols = [c for c in files.columns if c != "content"]

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            paths, sizes = batch.column(cols.index("path")).to_pylist(), batch.column(cols.index("size")).to_pylist()
            first, held, kept = 0, 0, []
            for k, (path, size) in enumerate(zip(paths, sizes, strict=True)):
                data = None
                if size <= limit:
                    with contextlib.suppress(OSError), fs.open_input_stream(path) as f:
                        data = f.read()
                kept.append(data)
                held += len(data or b"")
                if held >= budget or k + 1 == len(paths):
                    yield pa.RecordBatch.from_arrays([*(c.slice(first, k + 1 - first) for c in batch.columns), pa.array(kept, pa.binary())], names=[*cols, "content"])
                    first, held, kept = k + 1, 0, []

    plain = files.select(*cols)
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("content", T.BinaryType())]))


def extension(path: Column) -> Column:
    """Lower-case last suffix with its dot; names that begin or end with a dot have none."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.when(name.endswith("."), F.lit("")).otherwise(F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)$", 1)))


def describe(content: Column) -> Column:
    """What the first bytes say the content is, in the phrases that bucket() looks for."""
    head = F.hex(F.substring(content, 1, 16))
    text = F.lower(F.make_valid_utf8(F.substring(content, 1, 512).cast("string")))
    starts = lambda *xs: F.coalesce(head.rlike("^(" + "|".join(xs) + ")"), F.lit(False))
    return (
        F.when(starts("25504446"), "PDF document")
        .when(starts("7B5C727466"), "Rich Text Format data")
        .when(starts("D0CF11E0A1B11AE1"), "Composite Document File V2 Document")
        .when(starts("504B0304", "504B0506"), "Zip archive data")
        .when(starts("1F8B"), "gzip compressed data")
        .when(starts("377ABCAF271C"), "7-zip archive data")
        .when(F.substring(content, 258, 5) == F.lit(b"ustar"), "POSIX tar archive")
        .when(starts("FFD8FF"), "JPEG image data")
        .when(starts("89504E470D0A1A0A"), "PNG image data")
        .when(starts("474946383761", "474946383961"), "GIF image data")
        .when(text.rlike(r"^\s*(<!doctype html|<html)"), "HTML document")
        .when(text.rlike(r"^\s*<\?xml"), "XML document")
        .otherwise("data")
    )


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for p in d.items() for x in p])


def bucket(ext: Column, mime: Column, specialized: bool = False) -> Column:
    """Bucket by extension, else by description, in the order of the rules."""
    m = F.lower(F.coalesce(mime, F.lit("")))
    has = lambda *ws: F.array_max(F.array(*[F.contains(m, F.lit(w)) for w in ws]))
    by = F.element_at(_map(EXTENSION_BUCKET), ext)
    rules = [(("pdf",), "pdf"), (("rich text format", "rtf"), "rtf"), (("composite document file",), "ole"), (("zip archive",), "archive"), (("tar archive", "gzip", "7-zip archive"), "archive"), (("jpeg", "png", "gif"), "image"), (("html",), "html"), (("csv",), "csv"), (("xml",), "xml")]
    out = F.when(ext.isin(list(SPECIALIZED_KIND)), "specialized").when(by.isNotNull(), by) if specialized else F.when(by.isNotNull(), by)
    for words, name in rules:
        out = out.when(has(*words), name)
    return out.otherwise("other")


def specialized_kind(ext: Column) -> Column:
    return F.coalesce(F.element_at(_map(SPECIALIZED_KIND), ext), F.lit("unknown"))


def classify(files: DataFrame, specialized: bool = False) -> DataFrame:
    """files with mime, bucket and extension."""
    df = files.withColumn("extension", extension(F.col("path"))).withColumn("mime", describe(F.col("content")))
    return df.withColumn("bucket", bucket(F.col("extension"), F.col("mime"), specialized))

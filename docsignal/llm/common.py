"""Helpers shared by the training-data operators: the shared folder, lineage cuts, vectorised words and hashes."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
_LOCAL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only for a single local JVM."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="docsignal-")
    return _LOCAL[app]


class Scratch:
    """Tables and files of one run in the shared folder. save() cuts the lineage; drop() frees what no later read needs."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_root(spark)}/docsignal-{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        df.write.mode("overwrite").option("compression", compression).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Fewer rows in an Arrow batch of whole texts bound what a Python worker and its JVM hold; the setting stays for the session."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def trim() -> None:
    """Give freed memory back to the system at a task's end; workers live on and several share an executor's limit."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def open_fs(uri: str):
    """(file system, path) of a URI or an absolute path."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(uri)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores added until no column has it, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def plus(schema: T.StructType, *columns: tuple[str, T.DataType]) -> T.StructType:
    """A schema with more columns; a column of the same name is the caller's to drop."""
    return T.StructType([*schema.fields, *(T.StructField(n, t) for n, t in columns)])


# ---- hashing -------------------------------------------------------------------------------------------------------

def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def word_class(text: str) -> np.ndarray:
    """256 flags: the bytes that are not in `text` (latin-1) belong to words."""
    t = np.ones(256, bool)
    t[list(text.encode("latin-1"))] = False
    return t


#: words are runs of bytes other than ASCII white space
NOT_SPACE = word_class(" \t\n\x0b\x0c\r")
#: words are runs of digits, letters and bytes over 0x7F
ALNUM = word_class("".join(chr(c) for c in [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)] if not 0x41 <= c <= 0x5A))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def text_slices(col: pa.Array, budget: int = 1 << 20):
    """(first row, end row, bytes, offsets) over runs of rows of about `budget` bytes; null is empty; a longer row comes alone."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()) if pa.types.is_string(col.type) else col.cast(pa.large_binary()), "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    n = len(col)
    if not n:
        return
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + budget, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each word; no word crosses an offset."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = flags[data]
    edge = offsets[(offsets > 0) & (offsets < n)]
    before = np.zeros(n, bool)
    before[1:] = w[:-1]
    before[edge] = False
    after = np.zeros(n, bool)
    after[:-1] = w[1:]
    after[edge - 1] = False
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


#: CHUNK_MASK[k] keeps the first k bytes of a little-endian chunk
CHUNK_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], U64)


def chunk_values(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position, little-endian, without those beyond `left` bytes; data ends in 8 more bytes."""
    every = np.ndarray(len(data) - 7, "<u8", data.data if data.flags.c_contiguous else data.copy().data, 0, (1,))
    return every[at] & CHUNK_MASK[np.minimum(left, 8)]


def span_groups(starts: np.ndarray, ends: np.ndarray, most: int = 1 << 17):
    """Runs [i, j) of spans with about `most` chunks of 8 bytes together; a longer span comes alone."""
    upto = np.cumsum((ends - starts + 7) >> 3)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def padded(data: np.ndarray, lo: int, hi: int, fold: bool) -> np.ndarray:
    """The bytes lo to hi and 8 zeros, A-Z lower-cased if fold."""
    part = data[lo:hi]
    out = np.zeros(hi - lo + 8, np.uint8)
    out[: len(part)] = LOWER[part] if fold else part
    return out


def span_chunks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(chunks, number of each in its span, first chunk and chunks of each span) of spans over padded data."""
    size = (ends - starts + 7) >> 3
    first = np.cumsum(size) - size
    k = np.arange(int(size.sum())) - np.repeat(first, size)
    return chunk_values(data, np.repeat(starts, size) + 8 * k, np.repeat(ends - starts, size) - 8 * k), k, first, size


def _key(k: np.ndarray, lane: int) -> np.ndarray:
    return mix64(k.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(0xD1B54A32D192ED03 * (lane + 1) & (1 << 64) - 1))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True, piece: int = 1 << 17, lane: int = 0) -> np.ndarray:
    """64-bit hashes of the spans' bytes, A-Z lower-cased if fold.

    Each chunk of 8 bytes is scattered together with its number in the span, and the sum is scattered with the length: no pattern
    of repeats within a span makes hashes meet, as it would for a polynomial modulo 2^64. `lane` chooses an independent function.
    """
    out, size = np.zeros(len(starts), U64), ends - starts
    short = (size > 0) & (size <= 8)
    rows = np.flatnonzero(short)  # most words: one chunk
    for i in range(0, len(rows), piece):
        r = rows[i : i + piece]
        lo = int(starts[r].min())
        out[r] = mix64(chunk_values(padded(data, lo, int(ends[r].max()), fold), starts[r] - lo, size[r]) + _key(np.zeros(1, np.int64), lane))
    rows = np.flatnonzero(size > 8)
    starts_, ends_ = starts[rows], ends[rows]
    for i, j in span_groups(starts_, ends_, piece):
        s, e, r = starts_[i:j], ends_[i:j], rows[i:j]
        if j == i + 1:  # in pieces, as it may be of any length
            for p in range(int(s[0]), int(e[0]), 8 * piece):
                q = min(int(e[0]), p + 8 * piece)
                v, k, _, _ = span_chunks(padded(data, p, q, fold), np.array([0]), np.array([q - p]))
                out[r] += mix64(v + _key(k + (p - int(s[0])) // 8, lane)).sum(dtype=U64, keepdims=True)
            continue
        lo = int(s.min())
        v, k, first, _ = span_chunks(padded(data, lo, int(e.max()), fold), s - lo, e - lo)
        out[r] = np.add.reduceat(mix64(v + _key(k, lane)), first)
    return mix64(out + size.astype(U64) * U64(0xD6E8FEB86659FD93))


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, pool: np.ndarray, pool_starts: np.ndarray, pool_ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """Whether each span has the bytes of its partner in `pool`, A-Z lower-cased in data if fold."""
    size = ends - starts
    same = size == pool_ends - pool_starts
    rows = np.flatnonzero(same & (size > 0))
    if len(rows):  # by their first chunk, which is all of most words
        lo, low = int(starts[rows].min()), int(pool_starts[rows].min())
        x = chunk_values(padded(data, lo, int(starts[rows].max()) + 8, fold), starts[rows] - lo, size[rows])
        same[rows] = x == chunk_values(padded(pool, low, int(pool_starts[rows].max()) + 8, False), pool_starts[rows] - low, size[rows])
        rows = rows[same[rows] & (size[rows] > 8)]
    for i, j in span_groups(starts[rows], ends[rows]):
        r = rows[i:j]
        for p in range(0, max(1, int((ends[r] - starts[r]).max())), 1 << 20):  # a long span is alone: in pieces
            a, e = starts[r] + p, np.minimum(ends[r], starts[r] + p + (1 << 20))
            b, f = pool_starts[r] + p, np.minimum(pool_ends[r], pool_starts[r] + p + (1 << 20))
            x, _, first, _ = span_chunks(padded(data, int(a.min()), int(e.max()), fold), a - a.min(), e - a.min())
            y, _, _, _ = span_chunks(padded(pool, int(b.min()), int(f.max()), False), b - b.min(), f - b.min())
            same[r] &= np.logical_and.reduceat(x == y, first)
    return same


def crc_mod(column, k: int):
    """crc32 of a value as text, modulo k."""
    return F.crc32(column.cast("string")) % k


# ---- connected components ----------------------------------------------------------------------------------------


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, name: str = "cc", most: int = 60) -> DataFrame:
    """(node, comp): the smallest node reachable over edges (a, b).

    Smallest-label spreading with a pointer jump each round, so rounds follow the logarithm of the diameter. Minima are
    aggregated before each shuffle and every round is a table in the shared folder: neither hubs nor lost executors matter.
    """
    both = scratch.save(edges.select("a", "b").where("a <> b").union(edges.select("b", "a").where("a <> b")).toDF("a", "b").distinct(), f"{name}-edges")
    labels = scratch.save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), f"{name}-0")
    for k in range(1, most):
        near = both.join(labels.toDF("b", "c"), "b").groupBy("a").agg(F.min("c").alias("c"))
        new = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("comp").alias("was"), F.least("comp", "c").alias("comp"))
        jump = labels.toDF("comp", "far")
        new = scratch.save(new.join(jump, "comp", "left").select("node", F.least("comp", F.coalesce("far", "comp")).alias("comp"), "was"), f"{name}-{k}")
        moved = new.where("comp <> was").limit(1).count()
        labels = new.select("node", "comp")
        if k > 1:
            scratch.drop(f"{name}-{k - 2}")
        if not moved:
            break
    else:
        raise RuntimeError("components did not settle")
    scratch.drop(f"{name}-edges", f"{name}-{k - 1}")
    return labels

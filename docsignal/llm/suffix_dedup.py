"""Exact repeated-passage removal by bucket-pointer refinement.

A window is a string of SPAN bytes; it repeats if its bucket, refined to SPAN bytes, holds another one.

1. Every text is cut into runs. The first buckets are those of GRAM bytes; a run holds neighbouring windows whose least bucket is
   the same one, so equal windows lie in runs of one bucket at the same distance from it. Runs of a bucket that occurs once are
   unique. Equal runs of a bucket (by 128 bits of their bytes) repeat as they are, and one of them stands for all.
2. The bytes of the distinct runs left are dealt by bucket, whole buckets to a task. There the windows are refined: each position
   points to the bucket of its QGRAM bytes, found by sorting; then the positions are sorted by their own bucket and the bucket of
   the position h later, which gives buckets of 2h bytes, and the new pointers serve the next round: 5, 10, 20, 40, 80, 160 and,
   from two overlapping buckets of 160, SPAN bytes. A position alone in its bucket leaves, as nothing longer there can repeat.
   Buckets are compared by the bytes themselves; no hash decides.
3. A bucket whose distinct runs are more than HOT bytes, such as a license line in all contexts, is refined over the cluster
   instead, by identifiers that depend on content alone: runs are cut into blocks of windows aligned at the bucket, blocks get the
   identifier of the bytes that their windows share, made from the buckets of GRAM bytes at later offsets, then windows get that of
   all their bytes. Whatever is alone in its bucket leaves, the rest is counted by identifiers of 128 bits.

So no task holds all occurrences of a bucket beyond HOT bytes: counts are aggregated before every shuffle and joins are on
identifiers.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Scratch, chunk_values, mix64, read, small_batches, span_hashes, text_slices, trim

SPAN, GRAM, QGRAM, BLOCK = 200, 40, 5, 16
REACH = SPAN - GRAM
#: bytes of distinct runs of one bucket that a task refines; positions are packed into 20 bits where fewer are refined at once
HOT, PACK = 1 << 20, 20
#: odd multipliers of the parts of an identifier, in two independent lanes
_ODD = [[U64(int(x) | 1) for x in mix64(np.arange(1, 7, dtype=U64) + U64(100 * lane + 7))] for lane in (0, 1)]


# ---- refinement by bytes -----------------------------------------------------------------------------------------


def _bucket(own: np.ndarray, later: np.ndarray | None, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of `at` sorted by (own, later), whether each begins a new bucket); n bounds positions and pointers, not first q-grams."""
    if n <= 1 << PACK:
        key = own.astype(U64) << U64(PACK)
        if later is not None:
            key = key << U64(PACK) | later.astype(U64) << U64(PACK)
        key = np.sort(key | at.astype(U64))
        order, key = (key & U64((1 << PACK) - 1)).astype(np.int64), key >> U64(PACK)
    else:
        key = own.astype(np.int64) if later is None else own.astype(np.int64) * n + later
        i = np.argsort(key, kind="stable")
        order, key = at[i], key[i]
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    return order, new


def repeated_windows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each position whether the SPAN bytes there, within one of the strings data[offsets[k]:offsets[k + 1]], occur again in any."""
    n = len(data)
    out = np.zeros(n, bool)
    if n < SPAN:
        return out
    end = np.repeat(offsets[1:], np.diff(offsets))
    pointer, alive = np.zeros(n, np.int64), np.zeros(n, bool)

    def point(order: np.ndarray, new: np.ndarray) -> None:
        """Positions that share a bucket point to its first place in the order; the others leave."""
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(order)))
        pointer[order] = np.repeat(first, size)
        alive[order] = np.repeat(size > 1, size)

    at = np.flatnonzero(np.arange(n) + QGRAM <= end)
    grams = chunk_values(np.concatenate([data, np.zeros(8, np.uint8)]), at, np.full(1, QGRAM))
    point(*_bucket(grams, None, at, n))
    for h, step in ((5, 5), (10, 10), (20, 20), (40, 40), (80, 80), (160, 40)):
        at = np.flatnonzero(alive)
        at = at[at + step + h <= end[at]]
        at = at[alive[at + step]]
        own, later = pointer[at], pointer[at + step]
        alive[:] = False
        if len(at):
            point(*_bucket(own, later, at, n))
    return alive


# ---- buckets of GRAM bytes -----------------------------------------------------------------------------------------


def identifiers(data: np.ndarray, lane: int = 0) -> np.ndarray:
    """An identifier of the GRAM bytes at each position, from the scattered 8 bytes there and at four later offsets."""
    m = len(data) - GRAM + 1
    eight = mix64(chunk_values(np.concatenate([data, np.zeros(8, np.uint8)]), np.arange(m + GRAM - 8), np.full(1, 8)))
    out = eight[:m] * _ODD[lane][0]
    for k in range(1, 5):
        out += eight[8 * k : 8 * k + m] * _ODD[lane][k]
    return mix64(out)


def chain(gram: np.ndarray, at: np.ndarray, steps: tuple[int, ...], lane: int) -> np.ndarray:
    """Identifiers of longer strings: those of GRAM bytes at positions `at` refined by those at later offsets, one after the other."""
    out = gram[at]
    for step in steps:
        out = mix64(out * _ODD[lane][5] + gram[at + step])
    return out


def least(gram: np.ndarray, n: int) -> np.ndarray:
    """The least identifier among the REACH + 1 positions of each of n windows."""
    a, k = gram, 1
    while 2 * k <= REACH + 1:
        a = np.minimum(a[:-k], a[k:])
        k *= 2
    return np.minimum(a[:n], a[REACH + 1 - k : REACH + 1 - k + n])


def find_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, start, windows, bucket, name, second name) of each run, and (document, start) of windows that repeat within one run."""
    none = np.zeros(0, np.int64)
    empty = (none, none, none, none.astype(U64), none.astype(U64), none.astype(U64), none, none)
    n = len(data) - SPAN + 1
    if n <= 0:
        return empty
    gram = identifiers(data)
    low = least(gram, n)
    valid = np.arange(n) + SPAN <= np.repeat(offsets[1:], np.diff(offsets))[:n]
    edge = np.ones(n, bool)
    edge[1:] = (low[1:] != low[:-1]) | ~valid[:-1]
    start = np.flatnonzero(valid & edge)
    if not len(start):
        return empty
    stop = np.zeros(n, bool)
    stop[:-1] = (low[1:] != low[:-1]) | ~valid[1:]
    stop[-1] = True
    end = np.flatnonzero(valid & stop) + 1
    bucket, count = low[start], end - start
    name, second = (span_hashes(data, start, end + SPAN - 1, fold=False, lane=k) for k in (0, 1))
    # a window can repeat within its run only where the bucket occurs twice within reach
    few = U64(int(0.08 * 2**64))
    at = np.flatnonzero(gram < few)
    at = at[np.argsort(gram[at], kind="stable")]
    two = np.flatnonzero((gram[at[1:]] == gram[at[:-1]]) & (at[1:] - at[:-1] <= REACH + 1))
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, np.maximum(at[two] - REACH, 0).clip(max=n), 1)
    np.add.at(mark, np.minimum(at[two + 1] + 1, n), -1)
    touched = np.concatenate([[0], np.cumsum(np.cumsum(mark[:-1]) > 0)])
    odd = np.flatnonzero((touched[end] > touched[start]) | (bucket >= few))
    again = none
    if len(odd):
        cut = np.concatenate([[0], np.cumsum(count[odd] + SPAN - 1)])
        from_ = np.concatenate([np.arange(start[k], end[k] + SPAN - 1) for k in odd])
        again = np.sort(from_[repeated_windows(data[from_], cut)])
    doc = np.searchsorted(offsets, start, "right") - 1
    again_doc = np.searchsorted(offsets, again, "right") - 1
    return doc, start - offsets[doc], count, bucket, name, second, again_doc, again - offsets[again_doc]


def _pieces(col: pa.Array, budget: int = 1 << 18):
    """(rows, data, offsets, shift) like text_slices; a longer text comes in pieces that overlap by SPAN - 1 bytes."""
    for i, j, data, off in text_slices(col, budget):
        if len(data) <= 2 * budget or j - i > 1:
            yield i, data, off, 0
        else:
            for a in range(0, len(data), budget):
                part = data[a : a + budget + SPAN - 1]
                yield i, part, np.array([0, len(part)]), a


def _ranges(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted window starts as (document, start, windows)."""
    if not len(at):
        return doc, at, at
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)]))
    return doc[new], at[new], np.diff(np.append(new, len(at)))


RUN = "doc_id long, dk long, at long, n long, bucket long, name long, second long, own boolean"


def _runs(documents: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0).cast(pa.int64()), batch.column(2)
            for i, data, off, shift in _pieces(batch.column(1)):
                doc, at, n, bucket, name, second, d2, a2 = find_runs(data, off)
                d2, a2, n2 = _ranges(d2, a2)
                rows = pa.array(np.concatenate([doc, d2]) + i)
                pad = np.zeros(len(d2), np.int64)
                long = [pa.array(np.concatenate([x.view(np.int64), pad])) for x in (bucket, name, second)]
                yield pa.RecordBatch.from_arrays([ids.take(rows), keys.take(rows), pa.array(np.concatenate([at, a2]) + shift), pa.array(np.concatenate([n, n2])), *long, pa.array(np.concatenate([np.zeros(len(doc), bool), np.ones(len(d2), bool)]))], names=["doc_id", "dk", "at", "n", "bucket", "name", "second", "own"])
        trim()

    return documents.select("doc_id", "text", "dk").mapInArrow(run, RUN)


def _listed(batches, emit, budget: int = 1 << 18):
    """emit(batch, [(row, start, windows, weight, bucket, bytes)]) for the runs listed with each text, of about `budget` bytes together."""
    for batch in batches:
        runs, todo, size = batch.column("runs"), [], 0
        for i, j, data, off in text_slices(batch.column("text")):
            for d in range(i, j):
                for r in runs[d].as_py():
                    todo.append((d, r["at"], r["n"], r["weight"], r["bucket"], data[off[d - i] + r["at"] : off[d - i] + r["at"] + r["n"] + SPAN - 1]))
                    size += len(todo[-1][-1])
                    if size > budget:
                        yield emit(batch, todo)
                        todo, size = [], 0
        if todo:
            yield emit(batch, todo)
    trim()


STRINGS = "doc_id long, dk long, at long, n long, weight long, bucket long, string binary"


def _strings(texts: DataFrame) -> DataFrame:
    """The bytes of the runs listed with each text."""

    def emit(batch, todo):
        rows, at, n, weight, bucket, string = zip(*todo, strict=True)
        rows = pa.array(rows)
        long = [pa.array(x, pa.int64()) for x in (at, n, weight, bucket)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()).take(rows), batch.column("dk").take(rows), *long, pa.array([x.tobytes() for x in string], pa.binary())], names=["doc_id", "dk", "at", "n", "weight", "bucket", "string"])

    return texts.mapInArrow(lambda batches: _listed(batches, emit), STRINGS)


def _refined(strings: DataFrame) -> DataFrame:
    """(doc_id, dk, at, n): repeated windows of the runs of weight 1, whole buckets refined at once; rows come sorted by bucket."""

    def refine(batch: pa.RecordBatch):
        string, off = batch.column("string"), np.frombuffer(batch.column("string").buffers()[1], np.int32)
        off = off[string.offset : string.offset + len(string) + 1].astype(np.int64)
        data = np.frombuffer(string.buffers()[2], np.uint8)[off[0] : off[-1]]
        off -= off[0]
        again = repeated_windows(data, off)
        again[np.repeat(batch.column("weight").to_numpy() > 1, np.diff(off))] = False
        at = np.flatnonzero(again)
        row = np.searchsorted(off, at, "right") - 1
        row, at, n = _ranges(row, at - off[row])
        pick = pa.array(row)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pick), batch.column("dk").take(pick), pa.array(at + batch.column("at").to_numpy()[row]), pa.array(n)], names=["doc_id", "dk", "at", "n"])

    def one(parts: list) -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    def run(batches):
        # whole buckets of about 2^PACK bytes together, or one alone
        group, held, open_, open_size = [], 0, [], 0
        bucket = None
        for batch in batches:
            key = batch.column("bucket").to_numpy()
            size = pc.binary_length(batch.column("string")).to_numpy()
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(edges, edges[1:], strict=False):
                if key[a] != bucket:
                    if group and held + open_size > 1 << PACK:
                        yield refine(one(group))
                        group, held = [], 0
                    group, held = group + open_, held + open_size
                    open_, open_size, bucket = [], 0, key[a]
                open_.append(batch.slice(a, b - a))
                open_size += int(size[a:b].sum())
        if group and held + open_size > 1 << PACK:
            yield refine(one(group))
            group = []
        if group + open_:
            yield refine(one(group + open_))
        trim()

    return strings.mapInArrow(run, "doc_id long, dk long, at long, n long")


NAME = "struct<a:long,b:long>"
BLOCKS = f"doc_id long, dk long, weight long, bucket long, block long, core {NAME}, whole {NAME}, at long, windows array<{NAME}>"


def _blocks(texts: DataFrame) -> DataFrame:
    """Blocks of windows of the runs listed with each text, with identifiers of two lanes."""

    def two(arrays) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(x.view(np.int64)) for x in arrays], ["a", "b"])

    def emit(batch, todo):
        ids, keys = batch.column("doc_id").cast(pa.int64()), batch.column("dk")
        data = np.concatenate([t[-1] for t in todo])
        length = np.array([len(t[-1]) for t in todo])
        off = np.concatenate([[0], np.cumsum(length)])
        grams = [identifiers(data, lane) for lane in (0, 1)]
        p = np.concatenate([np.arange(a, b - SPAN + 1) for a, b in zip(off, off[1:], strict=False)])
        owner = np.repeat(np.arange(len(todo)), length - SPAN + 1)
        low = least(grams[0], len(data) - SPAN + 1)[p]
        value = np.repeat(low[np.searchsorted(p, off[:-1])], length)[: len(grams[0])]
        same = np.flatnonzero(grams[0] == value)
        a = same[np.searchsorted(same, p)]  # the first place of the bucket in each window
        block = (a - p) // BLOCK
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (block[1:] != block[:-1]) | (owner[1:] != owner[:-1])]))
        last = np.append(new[1:], len(p)) - 1
        first = a[new] - BLOCK * block[new]
        window = [chain(grams[lane], p, (40, 80, 120, 160), lane) for lane in (0, 1)]
        core = [chain(grams[lane], first, (40, 80, 120, SPAN - BLOCK + 1 - GRAM), lane) for lane in (0, 1)]
        whole = [mix64(window[lane][new] * _ODD[lane][5] + window[lane][last]) for lane in (0, 1)]
        o = owner[new]
        rows = pa.array(np.array([t[0] for t in todo])[o])
        at = p[new] - off[o] + np.array([t[1] for t in todo])[o]
        lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(p)), pa.int32()), two(window))
        return pa.RecordBatch.from_arrays(
            [ids.take(rows), keys.take(rows), pa.array(np.array([t[3] for t in todo], np.int64)[o]), pa.array(low[new].view(np.int64)), pa.array(block[new].astype(np.int64)), two(core), two(whole), pa.array(at), lists],
            names=["doc_id", "dk", "weight", "bucket", "block", "core", "whole", "at", "windows"],
        )

    return texts.mapInArrow(lambda batches: _listed(batches, emit), BLOCKS)


def _hot_ranges(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, dk, at, n): repeated windows of the runs of weight 1 of hot buckets, refined by identifiers over the cluster."""
    blocks = scratch.save(_blocks(texts), "blocks")
    cores = blocks.groupBy("bucket", "block", "core").agg(F.sum("weight").alias("m"), F.min("whole").alias("lo"), F.max("whole").alias("hi")).where("m > 1")
    cores = scratch.save(cores.select(F.col("bucket").alias("b"), F.col("block").alias("o"), F.col("core").alias("x"), F.expr("lo = hi").alias("all")), "cores")
    met = scratch.save(blocks.join(cores, F.expr("bucket = b and block = o and core = x")).select("doc_id", "dk", "weight", "bucket", "at", "windows", "all"), "met")
    full = met.where("all and weight = 1").select("doc_id", "dk", "at", F.size("windows").cast("long").alias("n"))
    single = met.where("not all").select("doc_id", "dk", "weight", "bucket", "at", F.posexplode("windows").alias("i", "window"))
    twice = scratch.save(single.groupBy("bucket", "window").agg(F.sum("weight").alias("m")).where("m > 1").select(F.col("bucket").alias("b"), F.col("window").alias("x")), "windows")
    last = single.where("weight = 1").join(twice, F.expr("bucket = b and window = x")).select("doc_id", "dk", (F.col("at") + F.col("i")).alias("at"), F.lit(1).cast("long").alias("n"))
    return full.union(last)


def repeated_ranges(spark: SparkSession, documents: DataFrame, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """(d, k, ranges): starts and numbers of repeated windows, of documents (doc_id, text, dk)."""
    runs = scratch.save(_runs(documents), "runs")
    grams = runs.where("not own").groupBy("bucket").agg(F.count("*").alias("m"), F.min(F.struct("name", "second")).alias("lo"), F.max(F.struct("name", "second")).alias("hi"))
    grams = scratch.save(grams.where("m > 1").select(F.col("bucket").alias("b"), F.expr("lo <> hi").alias("mixed")), "buckets")
    shared = scratch.save(runs.where("not own").join(grams, F.expr("bucket = b")).drop("b", "own"), "shared")
    alike = shared.where("not mixed").select("doc_id", "dk", "at", "n")
    own = runs.where("own").select("doc_id", "dk", "at", "n")
    mixed = shared.where("mixed")
    by_name = mixed.groupBy("bucket", "name", "second").agg(F.count("*").alias("c"), F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "dk", "at", "n")).alias("one"))
    by_name = scratch.save(by_name, "names")
    equal = mixed.join(by_name.where("c > 1").select(F.col("bucket").alias("b"), F.col("name").alias("x"), F.col("second").alias("y")), F.expr("bucket = b and name = x and second = y")).select("doc_id", "dk", "at", "n")
    size = by_name.groupBy("bucket").agg(F.sum(F.col("one.n") + (SPAN - 1)).alias("size")).where(F.col("size") > hot).select(F.col("bucket").alias("b"))
    size = scratch.save(size, "hot")
    found = [alike, own, equal]
    for name, join in (("usual", "left_anti"), ("hot", "left_semi")):
        if name == "hot" and not size.limit(1).count():
            continue
        one = by_name.join(size, F.expr("bucket = b"), join)
        lists = one.select("one.*", F.least("c", F.lit(2)).alias("weight"), "bucket").groupBy("doc_id", "dk").agg(F.collect_list(F.struct("at", "n", "weight", "bucket")).alias("runs"))
        lists = scratch.save(lists.select(F.col("doc_id").alias("d"), F.col("dk").alias("k"), "runs"), f"lists-{name}")
        texts = documents.join(lists, F.expr("doc_id <=> d and dk = k")).select("doc_id", "dk", "text", "runs")
        if name == "usual":
            dealt = _strings(texts).repartition("bucket").sortWithinPartitions("bucket")
            found.append(scratch.save(_refined(dealt), "refined"))
        else:
            found.append(_hot_ranges(texts, scratch))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    ranges = every.groupBy("doc_id", "dk").agg(F.collect_set(F.struct("at", "n")).alias("ranges")).select(F.col("doc_id").alias("d"), F.col("dk").alias("k"), "ranges")
    ranges = scratch.save(ranges, "ranges")
    scratch.drop("runs", "shared", "blocks", "met", "buckets", "names", "lists-usual", "lists-hot", "cores", "windows", "refined", "hot")
    return ranges


def remove_repeats(spark: SparkSession, documents: DataFrame, hot: int = HOT) -> DataFrame:
    """Per row of documents (doc_id, n_bytes, n_removed, n_spans, kept): kept is the text without repeated bytes, as bytes.

    Null texts count as empty. Rows repeated, with equal or null doc_ids, are documents of their own: an equal text elsewhere
    repeats. Texts shorter than SPAN bytes lose nothing; long ones are searched in pieces. Other columns, whatever their names, are
    ignored. An empty table gives an empty result.
    """
    scratch = Scratch(spark, "op10")
    small_batches(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("dk", F.xxhash64("text"))
    ranges = repeated_ranges(spark, docs, scratch, hot)

    def run(batches):
        for batch in batches:
            rows = []
            listed = batch.column("ranges")
            for i, j, data, off in text_slices(batch.column("text")):
                for d in range(i, j):
                    text = data[off[d - i] : off[d - i + 1]]
                    r = listed[d].as_py()
                    if not r:
                        rows.append((len(text), 0, 0, text.tobytes()))
                        continue
                    mark = np.zeros(len(text) + 1, np.int32)
                    at, n = np.array([x["at"] for x in r]), np.array([x["n"] for x in r])
                    np.add.at(mark, at, 1)
                    np.add.at(mark, at + n + SPAN - 1, -1)
                    gone = np.cumsum(mark[:-1]) > 0
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    rows.append((len(text), int(gone.sum()), spans, text[~gone].tobytes()))
            a, b, c, kept = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = docs.join(ranges, F.expr("doc_id <=> d and dk = k"), "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """remove_repeats() of all documents, with what stays as a checksum."""
    return remove_repeats(spark, read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], span: int = SPAN) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text by counting every string of `span` bytes; for tests."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + span] for r in raw for i in range(len(r) - span + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - span + 1):
            if seen[r[i : i + span]] > 1:
                gone[i : i + span] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) > 0).sum())
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out

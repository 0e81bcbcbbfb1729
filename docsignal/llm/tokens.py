"""Token-id output as directly addressable codes.

A shard holds the ids of consecutive documents. Each id is cut into chunks of `width` bits, lowest first; level k holds the k-th
chunks of the ids that have one, and a bitmap says which ids go on. A rank directory (set bits before each block of 512) leads
from a position of one level to its position in the next, so any token is read with one probe a level and nothing is decoded
before it.

Shard file, little-endian: magic b"DACS", u32 version, u32 width, u32 levels, u64 documents, u64 tokens; then a directory of
u64 (offset, bytes) pairs: doc ids (i64), null flags (u8), starts (u64, documents + 1), and for each level chunks, bitmap (u64
words), ranks (u64).
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, Scratch, open_fs, read, same_spans, small_batches, span_hashes, text_slices, trim

MAGIC, VERSION, RANK_BITS = b"DACS", 1, 512
END_ID = 2
#: bounds of doc_id between tasks are no more than this; beyond it parts grow
MOST_PARTS = 100_000


# ---- codes ---------------------------------------------------------------------------------------------------------


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Chunks of `width` bits (1 to 16), as bytes; widths 8 and 16 are plain arrays."""
    if width == 8:
        return values.astype(np.uint8)
    if width == 16:
        return values.astype("<u2").view(np.uint8)
    bits = (values.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")


def unpack(data: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """The chunks at the positions `at`."""
    if width == 8:
        return data[at].astype(np.uint32)
    if width == 16:
        return data.view("<u2")[at].astype(np.uint32)
    pad = np.concatenate([data, np.zeros(4, np.uint8)])
    bit = at * width
    byte = bit >> 3
    word = pad[byte].astype(np.uint32) | pad[byte + 1].astype(np.uint32) << 8 | pad[byte + 2].astype(np.uint32) << 16
    return (word >> (bit & 7).astype(np.uint32)) & np.uint32((1 << width) - 1)


def _bitmap(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = -(-max(1, len(flags)) // RANK_BITS) * (RANK_BITS // 64)
    bits = np.zeros(words * 8, np.uint8)
    raw = np.packbits(flags, bitorder="little")
    bits[: len(raw)] = raw
    bits = bits.view("<u8")
    per = np.bitwise_count(bits).astype(np.uint64).reshape(-1, RANK_BITS // 64).sum(1, dtype=np.uint64)
    return bits, np.concatenate([[np.uint64(0)], np.cumsum(per)[:-1]]).astype("<u8")


def _rank(bits: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Set bits before each position."""
    block, word = at // RANK_BITS, at >> 6
    out = ranks[block].astype(np.int64)
    step = RANK_BITS // 64
    for k in range(step - 1):
        w = block * step + k
        out += np.where(w < word, np.bitwise_count(bits[w]).astype(np.int64), 0)
    low = bits[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
    return out + np.bitwise_count(low).astype(np.int64)


def encode_shard(doc_ids: list[int | None], sizes: np.ndarray, values: np.ndarray, width: int = 8) -> bytes:
    """The bytes of a shard: values are the unsigned ids of all its documents in turn, sizes how many each has."""
    values = values.astype(np.uint32)
    parts = [np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], np.uint8), np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")]
    levels = 0
    while levels == 0 or len(values):
        on = values >> np.uint32(width) > 0
        bits, ranks = _bitmap(on)
        parts += [pack(values & np.uint32((1 << width) - 1), width), bits, ranks]
        values = values[on] >> np.uint32(width)
        levels += 1
    blobs = [p.tobytes() for p in parts]
    head = struct.pack("<4sIIIQQ", MAGIC, VERSION, width, levels, len(doc_ids), int(sizes.sum()))
    at, directory = len(head) + 16 * len(blobs), b""
    for b in blobs:
        directory += struct.pack("<QQ", at, len(b))
        at += len(b) + -len(b) % 8
    return b"".join([head, directory, *(b + b"\0" * (-len(b) % 8) for b in blobs)])


class Shard:
    """Random access to a shard in a buffer."""

    def __init__(self, data):
        magic, version, self.width, self.levels, self.documents, self.tokens = struct.unpack_from("<4sIIIQQ", data, 0)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token shard of this version")
        kinds = ["<i8", "u1", "<u8"] + ["u1", "<u8", "<u8"] * self.levels
        parts = [np.frombuffer(data, np.dtype(k), n // np.dtype(k).itemsize, at) for k, (at, n) in zip(kinds, struct.iter_unpack("<QQ", bytes(data[32 : 32 + 16 * len(kinds)])), strict=True)]
        self.doc_ids, self.nulls, self.starts = parts[0], parts[1], parts[2].astype(np.int64)
        self.level = [tuple(parts[k : k + 3]) for k in range(3, len(parts), 3)]

    def __getitem__(self, at) -> np.ndarray:
        """Ids at any positions of the shard's token sequence."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        out, rows = np.zeros(len(at), np.uint32), np.arange(len(at))
        for k, (chunks, bits, ranks) in enumerate(self.level):
            out[rows] |= unpack(chunks, self.width, at) << np.uint32(k * self.width)
            on = (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
            rows, at = rows[on], _rank(bits, ranks, at[on])
            if not len(rows):
                break
        return out

    def range(self, a: int, b: int) -> np.ndarray:
        """Ids at positions a to b: one rank a level, then the levels' chunks in a row."""
        out, at = np.zeros(b - a, np.uint32), None
        for k, (chunks, bits, ranks) in enumerate(self.level):
            if b <= a:
                break
            part = unpack(chunks, self.width, np.arange(a, b)) if self.width != 8 else chunks[a:b].astype(np.uint32)
            on = np.flatnonzero(np.unpackbits(bits.view(np.uint8)[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 : (a & 7) + b - a])
            if at is None:
                out |= part
                at = on
            else:
                out[at] |= part << np.uint32(k * self.width)
                at = at[on]
            a = int(_rank(bits, ranks, np.array([a]))[0])
            b = a + len(on)
        return out

    def document(self, i: int) -> np.ndarray:
        return self.range(int(self.starts[i]), int(self.starts[i + 1]))


# ---- encoding --------------------------------------------------------------------------------------------------------


#: byte classes: letter, digit, other, blank, other white space
_KIND = np.full(256, 2, np.uint8)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 0
_KIND[0x30:0x3A] = 1
_KIND[0x20] = 3
_KIND[[9, 10, 11, 12, 13]] = 4
#: the letter that byte-level vocabularies write for each byte: its own if that is visible, else one from U+0100 on
_OWN = np.isin(np.arange(256), [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)])
_LETTER = np.where(_OWN, np.arange(256), 0xFF + np.cumsum(~_OWN)).astype("<u2")


def split_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begins, odd): where the pre-tokens of byte-level vocabularies begin, and which texts hold what these rules don't cover.

    Covered are ASCII and the Latin-1 letters: runs of letters, of digits and of other marks, each with one blank before it; the
    endings 's 't 're 've 'm 'll 'd; white space, whose last character before a word stands alone or goes with the word.
    """
    n = len(data)
    begins, odd = np.zeros(n, bool), np.zeros(len(offsets) - 1, bool)
    if not n:
        return begins, odd
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    last = first[1:].copy()
    last[-1] = True
    first = first[:-1]
    kind = _KIND[data]
    before, after = np.roll(data, 1), np.roll(data, -1)
    high = data >= 0x80
    follows = (before == 0xC3) & ~first & (data >= 0x80) & (data <= 0xBF) & (data != 0x97) & (data != 0xB7)
    leads = (data == 0xC3) & ~last & np.roll(follows, -1)
    strange = (high & ~follows & ~leads) | ((data >= 0x1C) & (data <= 0x1F))
    if strange.any():
        odd[np.searchsorted(offsets, np.flatnonzero(strange), "right") - 1] = True
    space = kind >= 3
    space_before = np.roll(space, 1)
    begins = np.where(space, ~space_before | (~np.roll(space, -1) & ~last), np.where(space_before, before != 0x20, kind != np.roll(kind, 1))) | first
    mark = np.flatnonzero((data == 0x27) & begins & ~last)
    if len(mark):
        pad = np.concatenate([data, np.zeros(2, np.uint8)])
        a, b = pad[mark + 1], pad[mark + 2]
        two = ~last[np.minimum(mark + 1, n - 1)] & (((a == 0x72) & (b == 0x65)) | ((a == 0x76) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C)))
        one = (a == 0x73) | (a == 0x74) | (a == 0x6D) | (a == 0x64)
        for hit, k in ((mark[one], 1), (mark[two], 2)):
            begins[hit + 1] = False
            inside = hit + 1 + k < n
            begins[(hit + 1 + k)[inside]] = True
    return begins, odd


class Encoder:
    """Ids of texts by the tokenizers library; each distinct pre-token is encoded once, found again by a hash and compared byte for byte."""

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        self.model, self.most = Tokenizer.from_file(path), most
        #: the same model for pre-tokens that are split already and spelled in its letters
        self.bare = Tokenizer(self.model.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        #: strings that the tokenizer takes out of a text before it splits it; texts that hold one are encoded whole
        self.added = [t.content.encode() for t in self.model.get_added_tokens_decoder().values() if t.content]
        pre = json.loads(self.model.to_str()).get("pre_tokenizer") or {}
        #: the rules of split_pieces are those of this pre-tokenizer; any other one gets whole texts
        self.plain = pre.get("type") == "ByteLevel" and bool(pre.get("use_regex")) and not pre.get("add_prefix_space") and self.model.normalizer is None
        vocab = self.model.get_vocab()
        self.dtype = "<u2" if max(vocab.values(), default=0) < 1 << 16 else "<u4"
        self.width = np.zeros(max(vocab.values(), default=0) + 1, np.int64)  # bytes of each token
        for token, i in vocab.items():
            self.width[i] = len(token)
        self._clear()

    def _clear(self) -> None:
        self.slots = np.zeros(1 << 16, np.int32)  # of a hash's low bits, the entry + 1; on a clash the next slot
        self.hash, self.first, self.count, self.flat, self.n, self.used = np.zeros(1024, U64), np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0, 0
        self.bytes, self.ends = np.zeros(8192, np.uint8), np.zeros(1025, np.int64)  # entry k is bytes[ends[k]:ends[k + 1]]

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.model.encode(text, add_special_tokens=False).ids, np.uint32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entries of hashes, -1 for those not seen."""
        mask = U64(len(self.slots) - 1)
        out, todo, at = np.full(len(h), -1, np.int64), np.arange(len(h)), (h & mask).astype(np.int64)
        while len(todo):
            e = self.slots[at].astype(np.int64) - 1
            same = (e >= 0) & (self.hash[e] == h[todo])
            out[todo[same]] = e[same]
            go = (e >= 0) & ~same
            todo, at = todo[go], (at[go] + 1) & int(mask)
        return out

    def _place(self, entries: np.ndarray) -> None:
        mask = len(self.slots) - 1
        at = (self.hash[entries] & U64(mask)).astype(np.int64)
        while len(entries):
            free = self.slots[at] == 0
            self.slots[at[free]] = entries[free] + 1  # of several in one slot the last stays
            lost = self.slots[at] != entries + 1
            entries, at = entries[lost], (at[lost] + 1) & mask

    def _learn(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encode new pre-tokens: all at once by the bare model, cut again by the tokens' bytes; one by one if its tokens don't fit them."""
        stops = np.cumsum(ends - starts)
        raw = data[np.repeat(starts - stops + ends - starts, ends - starts) + np.arange(stops[-1])]
        text = np.full(len(raw) + len(stops), 0x20, "<u2")  # a blank after each; the pre-tokens' own blanks have another letter
        text[np.arange(len(raw)) + np.repeat(np.arange(len(stops)), ends - starts)] = _LETTER[raw]
        flat = np.asarray(self.bare.encode_batch_fast([text.tobytes().decode("utf-16-le")], add_special_tokens=False)[0].ids, np.uint32)
        upto = np.cumsum(self.width[flat])
        cut = np.searchsorted(upto, stops) + 1
        if len(flat) and upto[-1] == stops[-1] and (upto[cut - 1] == stops).all():
            count = np.diff(cut, prepend=0)
        else:
            pieces = [raw[a:b].tobytes().decode() for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]
            ids = [np.asarray(e.ids, np.uint32) for e in self.model.encode_batch_fast(pieces, add_special_tokens=False)]
            count, flat = np.array([len(x) for x in ids], np.int64), np.concatenate(ids)
        n, m = self.n + len(h), self.used + len(flat)
        while len(self.hash) < n:
            self.hash, self.first, self.count = (np.concatenate([a, np.zeros_like(a)]) for a in (self.hash, self.first, self.count))
        while len(self.ends) <= n:
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ends[self.n + 1 : n + 1] = self.ends[self.n] + stops
        while len(self.bytes) < self.ends[n]:
            self.bytes = np.concatenate([self.bytes, np.zeros_like(self.bytes)])
        self.bytes[self.ends[self.n] : self.ends[n]] = raw
        while len(self.flat) < m:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.hash[self.n : n], self.count[self.n : n] = h, count
        self.first[self.n : n] = self.used + np.cumsum(count) - count
        self.flat[self.used : m] = flat
        old, self.n, self.used = self.n, n, m
        if 3 * n > len(self.slots):
            self.slots = np.zeros(4 * len(self.slots), np.int32)
            old = 0
        self._place(np.arange(old, n))

    def _hold_added(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts hold an added token's string."""
        out, raw = np.zeros(len(offsets) - 1, bool), data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                d = int(np.searchsorted(offsets, at, "right")) - 1
                inside = at + len(token) <= offsets[d + 1]  # else it runs over into the next text
                out[d] |= inside
                at = raw.find(token, int(offsets[d + 1]) if inside else at + 1)
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, ids of each)."""
        n = len(offsets) - 1
        begins, odd = split_pieces(data, offsets) if self.plain else (np.zeros(len(data), bool), np.ones(n, bool))
        if self.plain:
            odd |= self._hold_added(data, offsets)
        starts = np.flatnonzero(begins)
        doc = np.searchsorted(offsets, starts, "right") - 1
        ends = np.append(starts[1:], len(data))
        keep = ~odd[doc]
        starts, ends, doc = starts[keep], ends[keep], doc[keep]
        h = span_hashes(data, starts, ends, fold=False)
        if self.n > self.most:
            self._clear()
        entry = self._find(h)
        new = np.flatnonzero(entry < 0)
        if len(new):
            fresh, at = np.unique(h[new], return_index=True)
            self._learn(fresh, data, starts[new[at]], ends[new[at]])
            entry[new] = self._find(h[new])
        # a text with another pre-token of the same hash is encoded whole
        odd[doc[~same_spans(data, starts, ends, self.bytes, self.ends[entry], self.ends[entry + 1], fold=False)]] = True
        count = self.count[entry]
        total = int(count.sum())
        into = np.cumsum(count) - count
        flat = self.flat[np.repeat(self.first[entry] - into, count) + np.arange(total)]
        sizes = np.bincount(doc, count, n).astype(np.int64)
        if odd.any():
            raw, cut, parts = data.tobytes(), np.concatenate([[0], np.cumsum(sizes)]), []
            for d in range(n):
                x = self.whole(raw[offsets[d] : offsets[d + 1]].decode("utf-8", "replace")) if odd[d] else flat[cut[d] : cut[d + 1]]
                sizes[d] = len(x)
                parts.append(x)
            flat = np.concatenate(parts)
        elif n and len(data):  # one text a call is encoded whole, against a tokenizer that splits otherwise
            d = int(np.argmin(np.where(sizes > 0, sizes, 1 << 60)))
            if not np.array_equal(self.whole(data[offsets[d] : offsets[d + 1]].tobytes().decode()), flat[sizes[:d].sum() :][: sizes[d]]):
                raise ValueError("the tokenizer splits texts in another way")
        return flat, sizes


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_documents(documents: DataFrame, tokenizer: str, bounds: list[int], null_parts: int = 0, end_id: int = END_ID) -> DataFrame:
    """(doc_id, part, n_tokens, ids, sum): ids of each whole text (null: empty) and the end id, little-endian u16, or u32 for large
    vocabularies, and their crc32. Parts ascend with (doc_id, sum): the rows of an id that fills several parts are dealt by sum."""

    def run(batches):
        enc = encoder(tokenizer)
        edge = np.array(bounds, np.int64)
        for batch in batches:
            docs = batch.column(0).cast(pa.int64())
            null, key = docs.is_null().to_numpy(zero_copy_only=False), docs.fill_null(0).to_numpy()
            low, high = np.searchsorted(edge, key, "left"), np.searchsorted(edge, key, "right")
            low, many = np.where(null, 0, low + null_parts), np.where(null, null_parts, high - low)
            for i, j, data, off in text_slices(batch.column(1)):
                flat, sizes = enc.encode(data, off)
                ends = np.cumsum(sizes + 1)
                out = np.full(int(ends[-1]), end_id, enc.dtype)
                hole = np.zeros(len(out), bool)
                hole[ends - 1] = True
                out[~hole] = flat
                step = out.dtype.itemsize
                blobs = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(np.concatenate([[0], ends * step]).astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())
                sums = np.array([zlib.crc32(out[a:b]) for a, b in zip(ends - sizes - 1, ends, strict=True)], np.int64)
                part = low[i:j] + (sums * np.maximum(many[i:j], 1) >> 32)
                yield pa.RecordBatch.from_arrays([docs[i:j], pa.array(part.astype(np.int32)), pa.array(sizes + 1), blobs, pa.array(sums)], names=["doc_id", "part", "n_tokens", "ids", "sum"])
        trim()

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, part int, n_tokens long, ids binary, sum long")


def write_shards(spark: SparkSession, documents: DataFrame, out: str, tokenizer: str, width: int = 8, shard_mb: int = 8) -> DataFrame:
    """Write `documents` as shards under `out`, in ascending doc_id order (null first; equal ids by the checksum of their tokens, then length).

    Returns the manifest (shard, path, documents, n_tokens, first_token), one small row a shard. Repeated rows stay, each a
    document; null and empty texts hold the end id alone; an empty table gives no shard. A text of any length is one document of
    one shard, held whole in a worker. A file's name carries the attempt that wrote it, and only the manifest's files count, so
    lost or repeated tasks leave no wrong data. Other columns, whatever their names, are ignored.

    Bounds of doc_id come from a scan of that column alone; texts are encoded where they are read and their ids shuffled once, each
    part to a task of its own. First tokens are prefix sums over groups of parts, then within a group.
    """
    work = Scratch(spark, "op1")
    small_batches(spark)
    stats = documents.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows"), F.count("doc_id").alias("n")).first()
    parts = max(1, -(-(stats.bytes or 0) // (shard_mb << 20)), min(spark.sparkContext.defaultParallelism, stats.rows // 1000))
    parts = int(min(parts, MOST_PARTS))
    null_parts = -(-parts * (stats.rows - stats.n) // max(1, stats.rows))
    bounds = []
    if parts > 1 and stats.n:
        bounds = documents.agg(F.percentile_approx(F.col("doc_id").cast("long"), [k / parts for k in range(1, parts)], max(10_000, 4 * parts))).first()[0] or []
    coded = encode_documents(documents, tokenizer, sorted(bounds), null_parts)
    step = encoder(tokenizer).dtype

    def run(batches):
        import uuid

        fs, base = open_fs(out)
        fs.create_dir(base, recursive=True)
        docs, sizes, flat, part, size, k = [], [], [], None, 0, 0

        def flush():
            name = f"tokens-{uuid.uuid4().hex}.dac"
            with fs.open_output_stream(f"{base}/{name}") as f:
                f.write(encode_shard(docs, np.concatenate(sizes), np.concatenate(flat), width))
            types = pa.schema([("part", pa.int64()), ("order", pa.int64()), ("path", pa.string()), ("documents", pa.int64()), ("n_tokens", pa.int64())])
            return pa.RecordBatch.from_pydict({"part": [part], "order": [k], "path": [f"{out}/{name}"], "documents": [len(docs)], "n_tokens": [size]}, schema=types)

        for batch in batches:
            each = batch.column("part").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(each)) + 1).tolist(), len(each)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                for i in range(lo, hi, 1000):
                    j = min(hi, i + 1000)
                    if docs and (each[i] != part or size >= shard_mb << 19):
                        yield flush()
                        docs, sizes, flat, size, k = [], [], [], 0, k + 1
                    ids = batch.column("ids").slice(i, j - i)
                    off = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + j - i + 1]
                    docs += batch.column("doc_id").slice(i, j - i).to_pylist()
                    sizes.append(np.diff(off) // np.dtype(step).itemsize)
                    flat.append(np.frombuffer(ids.buffers()[2], np.uint8)[off[0] : off[-1]].view(step).copy() if off[-1] > off[0] else np.zeros(0, step))
                    part, size = int(each[i]), size + int(sizes[-1].sum())
        if docs:
            yield flush()
        docs, sizes, flat = [], [], []
        trim()

    dealt = coded.repartitionById(parts + null_parts + 1, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "sum", "n_tokens").drop("sum")
    written = work.save(dealt.mapInArrow(run, "part long, order long, path string, documents long, n_tokens long"), "written").withColumn("group", F.floor(F.col("part") / 256))
    upto = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)  # a row for each 256 parts
    groups = written.groupBy("group").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("s"))
    groups = groups.select(F.col("group").alias("g"), F.coalesce(F.sum("t").over(upto), F.lit(0)).alias("t0"), F.coalesce(F.sum("s").over(upto), F.lit(0)).alias("s0"))
    own = Window.partitionBy("group").orderBy("part", "order")
    rows = written.join(groups, F.expr("group = g"))
    first = F.col("t0") + F.coalesce(F.sum("n_tokens").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    manifest = rows.select((F.col("s0") + F.row_number().over(own) - 1).cast("long").alias("shard"), "path", "documents", "n_tokens", first.cast("long").alias("first_token"))
    manifest = work.save(manifest, "manifest")
    work.drop("written")
    return manifest


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, ids as little-endian u32, each task reading whole shards."""

    def run(batches):
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first_token").to_pylist(), strict=True):
                fs, p = open_fs(path)
                with fs.open_input_file(p) as f:
                    s = Shard(f.read())
                for i in range(0, s.documents, 256):
                    j = min(i + 256, s.documents)
                    x = s.range(int(s.starts[i]), int(s.starts[j])).astype("<u4")
                    at = s.starts[i : j + 1] - s.starts[i]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(s.doc_ids[i:j], pa.int64(), mask=s.nulls[i:j] > 0), pa.array(s.starts[i:j] + first, pa.int64()), pa.array(np.diff(s.starts[i : j + 1]), pa.int64()), pa.array([x[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )
                del s
        trim()

    n = max(1, manifest.count())
    return manifest.select("path", "first_token").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


class RangedShard:
    """Tokens of a shard in a seekable file: its directory is read once, then for each level a chunk, a block of the bitmap and its rank."""

    def __init__(self, file):
        self.file = file
        magic, version, self.width, self.levels, self.documents, self.tokens = struct.unpack("<4sIIIQQ", self._read(0, 32))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token shard of this version")
        self.parts = list(struct.iter_unpack("<QQ", self._read(32, 16 * (3 + 3 * self.levels))))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def __getitem__(self, at: int) -> int:
        if not 0 <= at < self.tokens:
            raise IndexError(at)
        out = 0
        for k in range(self.levels):
            chunks, bits, ranks = (self.parts[3 + 3 * k + i][0] for i in range(3))
            bit = at * self.width
            raw = int.from_bytes(self._read(chunks + (bit >> 3), ((bit & 7) + self.width + 7) >> 3), "little")
            out |= (raw >> (bit & 7) & ((1 << self.width) - 1)) << k * self.width
            block = int.from_bytes(self._read(bits + at // RANK_BITS * (RANK_BITS >> 3), RANK_BITS >> 3), "little")
            inside = at % RANK_BITS
            if not block >> inside & 1:
                break
            at = struct.unpack("<Q", self._read(ranks + 8 * (at // RANK_BITS), 8))[0] + (block & ((1 << inside) - 1)).bit_count()
        return out


def token_at(spark: SparkSession, manifest: DataFrame, positions: list[int]) -> list[int]:
    """Tokens at global positions: only their shards' directories and the bytes that each probe needs are read."""
    want = spark.createDataFrame([(int(p),) for p in sorted(set(positions))], "p long")
    hit = manifest.join(F.broadcast(want), F.expr("p >= first_token and p < first_token + n_tokens")).select("p", "path", "first_token")
    out = {}
    for r in hit.orderBy("p").collect():  # a row a position asked for
        fs, path = open_fs(r.path)
        with fs.open_input_file(path) as f:
            out[r.p] = RangedShard(f)[r.p - r.first_token]
    return [out[p] for p in positions]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digest(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of documents, written as shards and read back; see write_shards for nulls, repeats and extremes."""
    out = Scratch(spark, "op1").path("shards")
    return read_shards(write_shards(spark, documents, out, tokenizer_path())).select("doc_id", "start", "n_tokens", F.crc32("ids").cast("long").alias("ids_crc32"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """digest() of all documents with the 50k byte-level vocabulary and end id 2."""
    return digest(spark, read(spark, sf_dir, "documents"))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())

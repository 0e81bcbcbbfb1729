"""Benchmark decontamination: a generalised suffix automaton of the test items, over which training text is streamed.

The automaton accepts every run of words of every item. A document's words walk it; after each word the state and the matched
length give the longest run of item words that ends there. A run of at least `window` words hits its last `window` words and
names the items below the state; an item shorter than a window counts where it is matched whole.

Items are dealt to blocks of a bounded number of words. Each block's automaton is built once, by a task, and written as flat arrays
that workers load. One filter over the words and the pairs of neighbouring words of all blocks finds the few runs of document
words in which a window can end; only these are walked, block after block, and compare by their bytes. So the cost of a text hardly
depends on the number of blocks, and where the arrays of all blocks exceed what a worker keeps, each is loaded once for
GATHER bytes of text.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from array import array
from bisect import bisect_left
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, U64, Scratch, mix64, open_fs, read, span_hashes, text_slices, trim, word_spans

WINDOW = 13
BLOCK_WORDS = 200_000
#: bytes of flat arrays that a worker keeps, and bytes of text for which a block is loaded if that is not enough
RESIDENT, GATHER = 192 << 20, 16 << 20


def words_of(text: str | None) -> list[bytes]:
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    s, e, _ = word_spans(data, np.array([0, len(data)]), ALNUM)
    raw = data.tobytes().lower() if data.size else b""
    return [raw[a:b] for a, b in zip(s, e, strict=True)]


class Automaton:
    """Generalised suffix automaton over sequences of symbols, built symbol by symbol."""

    def __init__(self, items: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        #: items of which some prefix ends in a state, and the state of each whole item
        self.ends: list[set[int]] = [set()]
        self.last = []
        for k, seq in enumerate(items):
            last = 0
            for c in seq:
                last = self._extend(last, c)
                while len(self.ends) < len(self.len):
                    self.ends.append(set())
                self.ends[last].add(k)
            self.last.append(last)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(length)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(length)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new


def _ragged(lists: list) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum([0, *map(len, lists)]).astype(np.int64), np.array([x for one in lists for x in one], np.int32)


def build_block(items: list[tuple[str | None, str | None]], window: int) -> dict[str, np.ndarray]:
    """The flat arrays of an automaton of the items (id, text).

    Per state: link, len, its first edge (sym, to) and home, the state that holds the last `window` symbols of a match; all other
    edges sorted by (state, symbol); at home states the items, as ragged lists; short items at the states where they are matched
    whole, and for each state the nearest such state up its links.
    """
    names: dict[tuple[bytes, ...], list[str | None]] = {}
    for name, text in items:
        if w := tuple(words_of(text)):
            names.setdefault(w, []).append(name)
    vocab = {w: i for i, w in enumerate(sorted({w for seq in names for w in seq}))}
    seqs = [[vocab[w] for w in seq] for seq in names]
    auto = Automaton(seqs)
    n = len(auto.len)
    length, link, ends = auto.len, auto.link, auto.ends
    at: dict[int, list[int]] = {}
    for s in sorted(range(1, n), key=lambda s: -length[s]):
        if length[s] >= window:
            if length[link[s]] >= window:
                ends[link[s]] |= ends[s]
            else:
                at[s] = sorted(ends[s])
        ends[s] = set()
    own: dict[int, list[int]] = {}
    for k, (seq, last) in enumerate(zip(seqs, auto.last, strict=True)):
        if len(seq) < window:
            own.setdefault(last, []).append(k)
    home, near = np.zeros(n, np.int32), np.zeros(n, np.int32)
    for s in sorted(range(1, n), key=lambda s: length[s]):
        home[s] = s if s in at else home[link[s]] if length[link[s]] >= window else 0
        near[s] = s if s in own else near[link[s]]
    sym, to, more = np.full(n, -1, np.int32), np.zeros(n, np.int32), []
    for s, edges in enumerate(auto.next):
        for k, c in enumerate(sorted(edges)):
            if k == 0:
                sym[s], to[s] = c, edges[c]
            else:
                more.append((s << 32 | c, edges[c]))
    words = list(vocab)
    stop = np.cumsum([len(w) for w in words]).astype(np.int64)
    raw = np.frombuffer(b"".join(words), np.uint8)
    h = span_hashes(raw, stop - [len(w) for w in words], stop) if words else np.zeros(0, U64)
    pairs = np.unique(np.array([(a, b) for s in seqs for a, b in zip(s, s[1:], strict=False)], np.int64).reshape(-1, 2), axis=0)
    at_states, own_states = sorted(at), sorted(own)
    at_from, at_items = _ragged([at[s] for s in at_states])
    own_from, own_items = _ragged([own[s] for s in own_states])
    arrays = {"link": np.array(link, np.int32), "len": np.array(length, np.int32), "sym": sym, "to": to, "home": home, "near": near, "size": np.array([len(s) for s in seqs], np.int32), "words": raw, "stop": stop}
    arrays |= {"more": np.array([k for k, _ in more], np.int64), "more_to": np.array([t for _, t in more], np.int32), "at": np.array(at_states, np.int32), "at_from": at_from, "at_items": at_items, "own": np.array(own_states, np.int32), "own_from": own_from, "own_items": own_items}
    arrays |= {"names": np.frombuffer(json.dumps(list(names.values())).encode(), np.uint8), "filter": np.concatenate([h, pair_hashes(h[pairs[:, 0]], h[pairs[:, 1]])]), "least": np.array([min((min(len(s), window) for s in seqs), default=0)])}
    return arrays


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * U64(0x9E3779B97F4A7C15) + b)


class Block:
    """A loaded automaton."""

    def __init__(self, arrays: dict[str, np.ndarray], window: int):
        flat = lambda name, code: array(code, arrays[name].tobytes())
        self.window, self.names = window, json.loads(arrays["names"].tobytes() or b"[]")
        self.link, self.len, self.sym, self.to, self.home, self.near, self.size = (flat(k, "i") for k in ("link", "len", "sym", "to", "home", "near", "size"))
        self.more, self.more_to = flat("more", "q"), flat("more_to", "i")
        raw, stop = arrays["words"].tobytes(), arrays["stop"].tolist()
        self.vocab = {raw[a:b]: i for i, (a, b) in enumerate(zip([0, *stop], stop, strict=False))}
        cut = lambda name: {s: arrays[f"{name}_items"][a:b].tolist() for s, a, b in zip(arrays[name].tolist(), arrays[f"{name}_from"].tolist(), arrays[f"{name}_from"][1:].tolist(), strict=False)}
        self.at, self.own = cut("at"), cut("own")

    def walk(self, words: list[bytes], mark, items: set[int]) -> None:
        """Feed the words; mark(first, last) the hit positions and add the items they name."""
        link, length, sym, to, more, window = self.link, self.len, self.sym, self.to, self.more, self.window
        s = n = 0
        for i, w in enumerate(words):
            c = self.vocab.get(w, -2)
            while True:
                if sym[s] == c:
                    s, n = to[s], n + 1
                    break
                key = s << 32 | c
                k = bisect_left(more, key) if c >= 0 else len(more)
                if k < len(more) and more[k] == key:
                    s, n = self.more_to[k], n + 1
                    break
                if s == 0:
                    n = 0
                    break
                s = link[s]
                n = length[s]
            if n >= window:
                mark(i - window + 1, i)
                items.update(self.at[self.home[s]])
            t = self.near[s]
            while t > 0:
                for k in self.own[t]:
                    if self.size[k] <= n:
                        mark(i - self.size[k] + 1, i)
                        items.add(k)
                t = self.near[link[t]]


class Scanner:
    """The blocks of a benchmark in a worker: their common filter, and the blocks used last."""

    def __init__(self, uris: list[str], window: int, resident: int = RESIDENT):
        self.uris, self.window, self.resident = uris, window, resident
        self.blocks: OrderedDict[str, tuple[Block, int]] = OrderedDict()
        self.loads = 0
        some = [self._arrays(u, ("filter", "least", "link")) for u in uris]
        self.least = min((int(a["least"][0]) for a in some if a["least"][0]), default=0)
        #: whether all blocks stay loaded
        self.fits = sum(BYTES_A_STATE * len(a["link"]) for a in some) <= resident
        n = sum(len(a["filter"]) for a in some)
        self.bits = max(10, int(16 * n).bit_length())
        self.table = np.zeros(1 << self.bits >> 3, np.uint8)
        for a in some:
            for at in self._spots(a["filter"]):
                np.bitwise_or.at(self.table, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def _arrays(self, uri: str, names: tuple[str, ...] | None = None) -> dict[str, np.ndarray]:
        fs, path = open_fs(uri)
        with fs.open_input_file(path) as f, np.load(io.BytesIO(f.read())) as z:
            return {k: z[k] for k in names or z.files}

    def _spots(self, h: np.ndarray) -> list[np.ndarray]:
        return [(x & U64((1 << self.bits) - 1)).astype(np.int64) for x in (h, h >> U64(64 - self.bits))]

    def _maybe(self, h: np.ndarray) -> np.ndarray:
        a, b = self._spots(h)
        return ((self.table[a >> 3] >> (a & 7)) & (self.table[b >> 3] >> (b & 7)) & 1) > 0

    def runs(self, h: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
        """[first, end) of the runs of words in which a window may end: known words, each pair of neighbours a pair of some item."""
        if not self.least or not len(h):
            return []
        known = self._maybe(h)
        linked = known[:-1] & known[1:] & (doc[:-1] == doc[1:])
        at = np.flatnonzero(linked)
        linked[at] = self._maybe(pair_hashes(h[at], h[at + 1]))
        first = np.flatnonzero(known & ~np.concatenate([[False], linked]))
        end = np.flatnonzero(known & ~np.concatenate([linked, [False]])) + 1
        keep = end - first >= self.least
        return list(zip(first[keep].tolist(), end[keep].tolist(), strict=True))

    def _block(self, uri: str) -> Block:
        if uri in self.blocks:
            self.blocks.move_to_end(uri)
        else:
            arrays = self._arrays(uri)
            self.blocks[uri] = (Block(arrays, self.window), BYTES_A_STATE * len(arrays["link"]))
            self.loads += 1
            while len(self.blocks) > 1 and sum(n for _, n in self.blocks.values()) > self.resident:
                self.blocks.popitem(last=False)
        return self.blocks[uri][0]

    def scan(self, slices: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple]:
        """(start, end, document, hit) of the words of each slice (bytes, offsets), and the items by document."""
        work, out = [], []
        for data, off in slices:
            s, e, doc = word_spans(data, off, ALNUM)
            delta, found = np.zeros(len(s) + 1, np.int32), {}
            for a, b in self.runs(span_hashes(data, s, e), doc):
                raw = data[s[a] : e[b - 1]].tobytes().lower()
                work.append((a, [raw[x:y] for x, y in zip((s[a:b] - s[a]).tolist(), (e[a:b] - s[a]).tolist(), strict=True)], delta, found.setdefault(int(doc[a]), set())))
            out.append((s, e, doc, delta, found))
        for uri in self.uris if work else ():
            block = self._block(uri)
            for a, words, delta, names in work:
                items: set[int] = set()

                def mark(i: int, j: int, a: int = a, delta: np.ndarray = delta) -> None:
                    delta[a + i] += 1
                    delta[a + j + 1] -= 1

                block.walk(words, mark, items)
                for k in items:
                    names.update(block.names[k])
        return [(s, e, doc, np.cumsum(delta[:-1]) > 0, found) for s, e, doc, delta, found in out]


#: bytes a state takes in a loaded block, its edges and its share of words and items included
BYTES_A_STATE = 64
_SCANNERS: dict[tuple, Scanner] = {}


def scanner(uris: list[str], window: int) -> Scanner:
    key = (tuple(uris), window)
    if key not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[key] = Scanner(uris, window)
    return _SCANNERS[key]


def write_blocks(benchmark: DataFrame, scratch: Scratch, window: int, block_words: int) -> list[str]:
    """Build and write one automaton for each block of items of about block_words words; a longer item may be most of a block."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where(F.length("text") > 0)
    n = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-n // (6 * block_words)))
    base = scratch.path("blocks")

    def run(batches):
        part: dict[int, list] = {}
        for batch in batches:
            for block, item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part.setdefault(block, []).append((item, text))
        fs, folder = open_fs(base)
        fs.create_dir(folder, recursive=True)
        for rows in part.values():
            arrays, name = build_block(rows, window), f"{uuid.uuid4().hex}.npz"
            buffer = io.BytesIO()
            np.savez(buffer, **arrays)
            with fs.open_output_stream(f"{folder}/{name}") as f:
                f.write(buffer.getvalue())
            yield pa.RecordBatch.from_pydict({"uri": [f"{base}/{name}"]})

    dealt = items.select(F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int").alias("block"), "item", "text").repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "item", "text")
    return sorted(r.uri for r in scratch.save(dealt.mapInArrow(run, "uri string"), "uris").collect())  # a row a block


def _gathered(batches, budget: int, k: int):
    """Batches in groups of about `budget` bytes of text, each with its slices (first row, end row, bytes, offsets)."""
    group, size = [], 0
    for batch in batches:
        slices = list(text_slices(batch.column(k)))
        group.append((batch, slices))
        size += sum(len(d) for _, _, d, _ in slices)
        if size >= budget:
            yield group
            group, size = [], 0
    if group:
        yield group


def _scanned(scan: Scanner, group: list):
    """Batches with their slices and what the scan of each slice gives."""
    results = iter(scan.scan([(data, off) for _, slices in group for _, _, data, off in slices]))
    for batch, slices in group:
        yield batch, [(*one, next(results)) for one in slices]


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items array<string>, spans array<struct<first:long,end:long>>"


def find_contamination(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: counts of words and of words inside item windows, the items named (as strings, sorted) and the hit spans in words.

    Null or empty texts have no words. Rows repeated or with null doc_id are scored each for itself. Items without words name
    nothing; an item with null id hits words but is not listed; of items with one id, one is listed. Other columns, whatever their
    names, are ignored. An empty table of documents gives an empty result, an empty benchmark no hits. A text is scanned whole: a
    worker holds about 40 bytes for each of its words beside it.
    """
    paths = write_blocks(benchmark, Scratch(spark, "op3"), window, block_words)

    def run(batches):
        scan = scanner(paths, window)
        for batch, slices in (x for group in _gathered(batches, 0 if scan.fits else GATHER, 1) for x in _scanned(scan, group)):
            rows = {k: [] for k in ("n_words", "n_hit", "items", "spans")}
            for i, j, _, _, (_, _, doc, hit, found) in slices:
                count = np.bincount(doc, minlength=j - i)
                hits = np.bincount(doc[hit], minlength=j - i)
                base = np.concatenate([[0], np.cumsum(count)])
                rows["n_words"] += count.tolist()
                rows["n_hit"] += hits.tolist()
                for d in range(j - i):
                    rows["items"].append(sorted(x for x in found.get(d, ()) if x is not None))
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[base[d] : base[d + 1]].view(np.int8), [0]]))) if hits[d] else np.zeros(0, np.int64)
                    rows["spans"].append([{"first": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(rows["n_words"], pa.int64()), pa.array(rows["n_hit"], pa.int64()), pa.array([len(x) for x in rows["items"]], pa.int64()), pa.array(rows["items"], pa.list_(pa.string())), pa.array(rows["spans"], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "n_words", "n_hit", "n_items", "items", "spans"],
            )
        trim()

    return documents.select("doc_id", "text").mapInArrow(run, RESULT)


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words") -> str:
    """Coverage limit: hit words are at least a twentieth of all words."""
    return f"{n_hit} > 0 and 20 * {n_hit} >= {n_words}"


def remove_spans(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """documents without those over the coverage limit, and without the hit spans of the rest.

    A span is cut from its first word's start to its last word's end. Clean documents keep their text byte for byte, null and
    empty ones too. Repeated rows, rows with null doc_id and all other columns, whatever their names, stay as they are; empty
    tables as in find_contamination.
    """
    paths = write_blocks(benchmark, Scratch(spark, "op3"), window, BLOCK_WORDS)
    cols, k = documents.columns, documents.columns.index("text")

    def run(batches):
        scan = scanner(paths, window)
        for batch, slices in (x for group in _gathered(batches, 0 if scan.fits else GATHER, k) for x in _scanned(scan, group)):
            keep, texts = [], batch.column(k).to_pylist()
            for i, j, data, off, (s, e, doc, hit, _) in slices:
                count, hits = np.bincount(doc, minlength=j - i), np.bincount(doc[hit], minlength=j - i)
                base = np.concatenate([[0], np.cumsum(count)])
                for d in range(j - i):
                    if hits[d] and 20 * hits[d] >= count[d]:
                        continue
                    keep.append(i + d)
                    if hits[d]:
                        raw, at = data[off[d] : off[d + 1]].tobytes(), 0
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[base[d] : base[d + 1]].view(np.int8), [0]]))) + base[d]
                        parts = []
                        for a, b in edge.reshape(-1, 2):
                            parts.append(raw[at : s[a] - off[d]])
                            at = e[b - 1] - off[d]
                        texts[i + d] = b"".join([*parts, raw[at:]]).decode("utf-8", "replace")
            out = [pa.array([texts[r] for r in keep], batch.column(k).type) if c == k else batch.column(c).take(pa.array(keep, pa.int64())) for c in range(len(cols))]
            yield pa.RecordBatch.from_arrays(out, names=cols)
        trim()

    return documents.mapInArrow(run, documents.schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_contamination() of all documents, with the items as a checksum."""
    found = find_contamination(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.selectExpr("doc_id", "n_words", "n_hit", "n_items", "sha2(array_join(items, ','), 256) as items_sha256", f"({contaminated()}) as contaminated")


def brute_force(texts: list[str | None], items: list[tuple[str | None, str | None]], window: int = WINDOW) -> list[tuple[int, int, list[str]]]:
    """(n_words, n_hit, items) of each text by comparing every window with every position; for tests."""
    out = []
    for text in texts:
        w, hit, names = words_of(text), set(), set()
        for name, item in items:
            x = words_of(item)
            for win in [x[i : i + window] for i in range(max(1, len(x) - window + 1))] if x else []:
                for i in range(len(w) - len(win) + 1):
                    if w[i : i + len(win)] == win:
                        hit.update(range(i, i + len(win)))
                        names.add(name)
        out.append((len(w), len(hit), sorted(x for x in names if x is not None)))
    return out


def sha(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()

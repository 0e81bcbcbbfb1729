"""Language id by bit-sliced Bloom filters over n-grams.

Each position of the table holds a mask with one bit a language; an n-gram's mask is the AND of its k positions and names every
language in which it was seen, be it once. A text's n-gram masks are counted by language and the expected false positives are taken
off (hits = own + (n - own) * fill^k). A second table holds the n-grams that a language has often, relative to its fitted documents;
the largest sum of both corrected counts decides, so that an n-gram seen by accident weighs half.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, U64, crc_mod, mix64, plus, read, text_slices, trim, unused
from .toxicity import held_out

BITS, HASHES, GRAM = 20, 2, 4
#: the table is put together in blocks of 2^BLOCK_BITS positions
BLOCK_BITS = 13
#: at most about so many documents of each language are fitted, chosen by a hash of doc_id
MOST_ROWS = 2000
#: a language has an n-gram often if this share of its fitted documents have it, at least one
OFTEN = 0.05
#: a longer text is counted in pieces of so many bytes
PIECE = 1 << 20
#: texts are taken together up to so many bytes: a byte of text takes some sixty while it is looked up
SLICE = 1 << 18

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_ASCII = _LETTER & (np.arange(256) < 128)
_FOLD = np.where(_LETTER, LOWER, 0x20).astype(np.uint8)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, n-gram of 4 bytes): letters folded to lower case, all else a blank; none has two blanks in a row or crosses texts."""
    n = len(data)
    if n < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    b = _FOLD[data]
    m = n - GRAM + 1
    g = b[:m].astype(np.uint32)
    for k in range(1, GRAM):
        g |= b[k : m + k].astype(np.uint32) << np.uint32(8 * k)
    blank = b == 0x20
    two = blank[:-1] & blank[1:]
    ok = ~(two[:m] | two[1 : m + 1] | two[2 : m + 2])
    for o in offsets[(offsets > 0) & (offsets < n)].tolist():
        ok[max(0, o - GRAM + 1) : min(m, o)] = False
    at = np.flatnonzero(ok)
    return np.searchsorted(offsets, at, "right") - 1, g[at]


def positions(g: np.ndarray) -> list[np.ndarray]:
    h = mix64(g)
    return [(h >> U64(BITS * k) & U64((1 << BITS) - 1)).astype(np.int64) for k in range(HASHES)]


@dataclass
class Filters:
    """table[slice][position]: the masks of up to 8 languages a slice; often: the same of the n-grams that a language has often."""

    langs: list[str]
    table: np.ndarray
    often: np.ndarray | None = None

    def false_rate(self, table: np.ndarray) -> np.ndarray:
        fill = [((table[k // 8] >> (k % 8)) & 1).mean() for k in range(len(self.langs))]
        return np.array(fill) ** HASHES

    def hits(self, table: np.ndarray, doc: np.ndarray, g: np.ndarray, n: int) -> np.ndarray:
        """Per document and language the n-grams whose mask names it."""
        return self._hits(table, doc, positions(g), n)

    def _hits(self, table: np.ndarray, doc: np.ndarray, at: list[np.ndarray], n: int) -> np.ndarray:
        hits = []
        for part in table:
            mask = part[at[0]]
            for p in at[1:]:
                mask &= part[p]
            by = np.bincount(doc * 256 + mask, minlength=n * 256).reshape(n, 256)
            hits += [by[:, (np.arange(256) >> k) & 1 > 0].sum(1) for k in range(8)]
        return np.stack(hits[: len(self.langs)], 1)

    def corrected(self, table: np.ndarray, hits: np.ndarray, total: np.ndarray) -> np.ndarray:
        fp = np.minimum(self.false_rate(table), 0.999)
        return np.maximum((hits - total[:, None] * fp) / (1 - fp), 0)

    def counts(self, doc: np.ndarray, g: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Per document: its n-grams, and by language those it has, corrected for false positives."""
        total = np.bincount(doc, minlength=n).astype(float)
        return total, self.corrected(self.table, self.hits(self.table, doc, g, n), total)

    def decide(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, share of the n-grams that it has) of each text; of equal sums the first language."""
        n = len(offsets) - 1
        tables = [self.table] if self.often is None else [self.table, self.often]
        total, hits = np.zeros(n), [np.zeros((n, len(self.langs))) for _ in tables]
        for p in range(0, max(1, len(data)), PIECE) if n == 1 else (0,):
            part, off = (data[p : p + PIECE + GRAM - 1], np.array([0, min(len(data) - p, PIECE + GRAM - 1)])) if n == 1 else (data, offsets)
            doc, g = grams(part, off)
            total += np.bincount(doc, minlength=n)
            at = positions(g)
            for table, sums in zip(tables, hits, strict=True):
                sums += self._hits(table, doc, at, n)
        own = [self.corrected(t, h, total) for t, h in zip(tables, hits, strict=True)]
        top = sum(own).argmax(1)
        return top, np.minimum(1.0, own[0][np.arange(n), top] / np.maximum(total, 1))


def train(spark: SparkSession, documents: DataFrame, most: int = MOST_ROWS, mod: int = 3, out: int = 1) -> Filters:
    """Filters of the languages in (doc_id, text, lang) rows whose crc32(doc_id as text) modulo `mod` is not `out`.

    Rows with null doc_id, text or lang are not learnt from; repeated rows count each. Counts and masks are made on the executors;
    what reaches the driver is 2^BITS bytes a slice and table.
    """
    own = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), mod) != out)).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = {r[0]: r[1] for r in own.groupBy("lang").count().collect()}  # one row a language
    langs = sorted(sizes)
    if not langs:
        return Filters([], np.zeros((1, 1 << BITS), np.uint8))
    tables = np.zeros((2, -(-len(langs) // 8), 1 << BITS), np.uint8)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, most / sizes[k])))])
    picked = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def run(batches):
        for batch in batches:
            index = {x: i for i, x in enumerate(langs)}
            lang = np.array([index[x] for x in batch.column(1).to_pylist()], np.int64)
            parts = []
            for i, j, data, off in text_slices(batch.column(0), SLICE):
                doc, g = grams(data, off)
                key = np.unique(doc << 32 | g.astype(np.int64))  # documents that have it, not occurrences
                parts.append(np.stack([lang[i + (key >> 32)], key & 0xFFFFFFFF]))
            key, count = np.unique(np.concatenate([p[0] << 32 | p[1] for p in parts]) if parts else np.zeros(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key >> 32), pa.array(key & 0xFFFFFFFF), pa.array(count)], names=["lang", "gram", "docs"])

    counts = picked.select("text", "lang").mapInArrow(run, "lang long, gram long, docs long").groupBy("gram", "lang").agg(F.sum("docs").alias("docs"))
    fitted = {r[0]: r[1] for r in picked.groupBy("lang").count().collect()}
    least = F.element_at(F.array(*[F.lit(max(1, int(np.ceil(OFTEN * fitted.get(k, 0))))) for k in langs]), (F.col("lang") + 1).cast("int"))

    def place(batches):
        for batch in batches:
            lang, gram, often = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            at = positions(gram.astype(np.uint32))
            level = np.concatenate([np.zeros(len(lang), np.int64), np.ones(int(often.sum()), np.int64)])
            rows = np.concatenate([np.arange(len(lang)), np.flatnonzero(often)])
            n = len(at)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(level, n)), pa.array(np.tile(lang[rows] // 8, n)), pa.array(np.concatenate([p[rows] for p in at])), pa.array(np.tile(np.int64(1) << lang[rows] % 8, n))], names=["level", "slice", "pos", "mask"])

    def packed(key, table):
        out = np.zeros(1 << BLOCK_BITS, np.uint8)
        out[table.column("pos").to_numpy() & ((1 << BLOCK_BITS) - 1)] = table.column("mask").to_numpy()
        return pa.table({"level": [key[0].as_py()], "slice": [key[1].as_py()], "block": [key[2].as_py()], "masks": pa.array([out.tobytes()], pa.binary())})

    slots = counts.select("lang", "gram", (F.col("docs") >= least).alias("often")).mapInArrow(place, "level long, slice long, pos long, mask long")
    slots = slots.groupBy("level", "slice", "pos").agg(F.bit_or("mask").alias("mask")).withColumn("block", F.shiftright("pos", BLOCK_BITS))
    for r in slots.groupBy("level", "slice", "block").applyInArrow(packed, "level long, slice long, block long, masks binary").collect():
        tables[r.level, r.slice, r.block << BLOCK_BITS : (r.block + 1) << BLOCK_BITS] = np.frombuffer(r.masks, np.uint8)
    return Filters(langs, *tables)


def predict(spark: SparkSession, documents: DataFrame, filters: Filters) -> DataFrame:
    """documents with two more columns, the last: lang_pred and lang_score, from whole texts; underscores are added where a name is taken.

    `und` and 0 for null texts and texts without a letter, and with no language learnt. Of equal counts the first language by code
    point wins; a text too short for an n-gram gets it with score 0. Repeated rows get equal results, an empty table stays empty. All
    columns stay, whatever their names. Long texts are counted in pieces.
    """
    cols = documents.columns
    names = unused(cols, "lang_pred", "lang_score")
    k = cols.index("text")
    shared = spark.sparkContext.broadcast(filters)  # 2^20 bytes for each 8 languages

    def run(batches):
        f = shared.value
        for batch in batches:
            pred, score = [], []
            for i, j, data, off in text_slices(batch.column(k), SLICE):
                n = j - i
                plain = np.logical_or.reduceat(np.append(_ASCII[data], False), np.minimum(off[:-1], len(data))) & (np.diff(off) > 0)
                if not f.langs:
                    pred += ["und"] * n
                    score += [0.0] * n
                    continue
                top, share = f.decide(data, off)
                for d in range(n):
                    if not plain[d] and not any(c.isalpha() for c in data[off[d] : off[d + 1]].tobytes().decode("utf-8", "replace")):
                        pred.append("und")
                        score.append(0.0)
                    else:
                        pred.append(f.langs[top[d]])
                        score.append(float(share[d]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*cols, *names])
        trim()

    return documents.mapInArrow(run, plus(documents.schema, (names[0], T.StringType()), (names[1], T.DoubleType())))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """predict() of all documents by filters that have seen none of the held-out ones."""
    docs = read(spark, sf_dir, "documents")
    filters = train(spark, docs)
    return predict(spark, docs.select("doc_id", "text"), filters).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))

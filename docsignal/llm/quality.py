"""Quality by histogram gradient-boosted trees over document statistics, flattened into arrays.

The statistics come from whole texts: sizes, letter classes, symbols, repeated words and lines. Trees are grown on binned
statistics level by level from gradient histograms; fitted trees are complete binary trees in three arrays (feature, threshold,
leaf), so a batch of rows goes down all of them with numpy indexing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, NOT_SPACE, plus, read, span_hashes, text_slices, unused, word_class, word_spans
from .toxicity import held_out, sample_labels, sampled_documents, scored, sigmoid

#: about so many labelled rows of each label are fitted at most, chosen by a hash of doc_id
MOST_ROWS = 10_000
THRESHOLD = 0.3
NAMES = ["log_bytes", "log_words", "log_lines", "word_len", "word_len_sd", "upper", "digit", "non_ascii", "space", "odd_symbol", "bang", "bar", "end_mark", "other_punct", "caps_words", "symbol_end_words", "distinct_words", "top_word", "same_neighbour", "repeated_lines", "repeated_line_words", "words_a_line", "short_words", "long_words", "newline"]
LINES = word_class("\n")
PIECE = 1 << 20


def _class(chars: str) -> np.ndarray:
    t = np.zeros(256)
    t[list(chars.encode("latin-1"))] = 1
    return t


_SETS = [_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), np.arange(256) >= 128, ~NOT_SPACE, _class("#$%&*@^~<>{}[]\\_=+"), _class("!"), _class("|"), _class(".?"), _class(",;:'\"()-/"), _class("\n")]
#: each byte's sets as bits, so one table look-up serves all
_BITS = np.zeros(256, np.uint16)
for _k, _s in enumerate(_SETS):
    _BITS |= np.asarray(_s, bool).astype(np.uint16) << _k
_LETTER = np.asarray(_class("abcdefghijklmnopqrstuvwxyz"), bool) | (np.arange(256) >= 128)


def _groups(doc: np.ndarray, h: np.ndarray, n: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: distinct hashes, the largest count of one, and the weight of occurrences after the first."""
    if not len(doc):
        z = np.zeros(n)
        return z, z, z
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(d)))
    top = np.zeros(n)
    np.maximum.at(top, d[first], count)
    w = (np.ones(len(d)) if weight is None else weight[order]) * ~new
    return np.bincount(d[first], minlength=n), top, np.bincount(d, w, n)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of NAMES for each document."""
    n, size = len(offsets) - 1, np.diff(offsets)
    some = np.maximum(size, 1)
    shares = np.zeros((n, len(_SETS)))
    # texts together in one piece; a long one alone, in several
    for p in range(0, max(1, len(data)), PIECE) if n == 1 else (0,):
        part = data[p : p + PIECE] if n == 1 else data
        byte_doc = np.repeat(np.arange(n), np.diff(offsets)) if n > 1 else np.zeros(len(part), np.int64)
        for lo in range(0, n, 4096):  # 1024 counters a text
            a, b = (offsets[lo], offsets[min(n, lo + 4096)]) if n > 1 else (0, len(part))
            m = min(n, lo + 4096) - lo
            by = np.bincount((byte_doc[a:b] - lo) * 1024 + _BITS[part[a:b]], minlength=m * 1024).reshape(m, 1024)
            shares[lo : lo + m] += np.stack([by[:, (np.arange(1024) >> k) & 1 > 0].sum(1) for k in range(len(_SETS))], 1)
    s, e, doc = word_spans(data, offsets, NOT_SPACE)
    words = np.bincount(doc, minlength=n)
    per = np.maximum(words, 1)
    length = (e - s).astype(float)
    mean = np.bincount(doc, length, n) / per
    sd = np.sqrt(np.maximum(np.bincount(doc, length**2, n) / per - mean**2, 0))
    h = span_hashes(data, s, e)
    caps = (LOWER[data[s]] != data[s]) & (LOWER[data[np.minimum(s + 1, e - 1)]] != data[np.minimum(s + 1, e - 1)]) if len(s) else np.zeros(0)
    last = data[e - 1] if len(e) else data[:0]
    bare = np.isin(last, np.frombuffer(b"#$%&*@^~=+!", np.uint8))
    kinds, top, _ = _groups(doc, h, n)
    same = np.bincount(doc[1:], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]), n) if len(h) > 1 else np.zeros(n)
    ls, le, ldoc = word_spans(data, offsets, LINES)
    lines = np.bincount(ldoc, minlength=n)
    lh = span_hashes(data, ls, le)
    _, _, again = _groups(ldoc, lh, n)
    _, _, weight = _groups(ldoc, lh, n, (le - ls).astype(float))
    x = np.column_stack(
        [np.log1p(size), np.log1p(words), np.log1p(lines), mean, sd, *(shares[:, :9] / some[:, None]).T, np.bincount(doc, caps, n) / per, np.bincount(doc, bare, n) / per, kinds / per, top / per, same / per, again / np.maximum(lines, 1), weight / some, words / np.maximum(lines, 1), np.bincount(doc, length <= 2, n) / per, np.bincount(doc, length >= 12, n) / per, shares[:, 9] / some]
    )
    return x


@dataclass
class Forest:
    """Complete trees of one depth: inner nodes in level order, then leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(trees):
            at = np.zeros(len(x), np.int64)
            while at.size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.threshold[t, at])
            z += self.leaf[t, at - inner]
        return z


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 3.0) -> Forest:
    inner = (1 << depth) - 1
    prior = float(np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(prior / (1 - prior)))
    if not len(y) or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    weight = weight / weight.mean()
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)])
    z, forest = np.full(len(y), base), ([], [], [])
    for _ in range(trees):
        p = sigmoid(z)
        g, h = (y - p) * weight, p * (1 - p) * weight
        at, feat, thr = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            lo, k = (1 << level) - 1, 1 << level
            slot, best = (at - lo) * bins, np.full(k, 1e-3)
            sg, sh = np.bincount(at - lo, g, k), np.bincount(at - lo, h, k)
            for f in range(x.shape[1]):
                cg = np.bincount(slot + binned[:, f], g, k * bins).reshape(k, bins).cumsum(1)
                ch = np.bincount(slot + binned[:, f], h, k * bins).reshape(k, bins).cumsum(1)
                gain = cg**2 / (ch + l2) + (sg[:, None] - cg) ** 2 / (sh[:, None] - ch + l2) - (sg**2 / (sh + l2))[:, None]
                gain[:, len(cuts[f]) :] = -1
                gain[(ch < 1) | (sh[:, None] - ch < 1)] = -1
                top = gain.argmax(1)
                win = np.flatnonzero(gain[np.arange(k), top] > best)
                best[win] = gain[win, top[win]]
                feat[lo + win], thr[lo + win] = f, cuts[f][top[win]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feat[at]] > thr[at])
        leaf = rate * np.bincount(at - inner, g, inner + 1) / (np.bincount(at - inner, h, inner + 1) + l2)
        z += leaf[at - inner]
        for store, a in zip(forest, (feat, thr, leaf), strict=True):
            store.append(a)
    return Forest(*map(np.array, forest), base)


def with_statistics(documents: DataFrame) -> DataFrame:
    """documents with one more column, the last: stats (array of NAMES); null texts count as empty. All columns stay, whatever their names;
    underscores are added to stats where that name is taken."""
    cols = documents.columns
    (name,) = unused(cols, "stats")
    k = cols.index("text")

    def run(batches):
        for batch in batches:
            x = [statistics(data, off) for _, _, data, off in text_slices(batch.column(k))]
            x = np.concatenate(x) if x else np.zeros((0, len(NAMES)))
            stats = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, stats], names=[*cols, name])

    return documents.mapInArrow(run, plus(documents.schema, (name, T.ArrayType(T.DoubleType()))))


def train(spark: SparkSession, documents: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Forest:
    """Trees fitted on about `most` labelled rows of each label. Of documents that share a doc_id one is learnt from, the one whose
    statistics come first; unlabelled documents and labels without a document are passed over; null texts count as empty. With empty
    tables every text gets one score."""
    sample, share = sample_labels(labels, "quality", 5, 0, most)
    rows = with_statistics(sampled_documents(documents, sample)).groupBy("doc_id").agg(F.min("stats").alias("stats"), F.max("label").alias("label"))
    got = rows.collect()  # as many rows as the sample
    got.sort(key=lambda r: (r.label, r.stats))
    y = np.array([r.label for r in got], float)
    w = np.array([share[r.label] for r in got])
    return fit(np.array([r.stats for r in got]).reshape(len(got), len(NAMES)), y, w)


def score(spark: SparkSession, documents: DataFrame, forest: Forest) -> DataFrame:
    """documents with one more column, the last: quality_score, from whole texts; underscores are added where that name is taken.

    Null and empty texts get the score of an empty text, rows that are repeated or tie get equal scores, an empty table stays empty.
    All columns stay, whatever their names. A worker holds about 60 bytes for each word of a text beside it.
    """
    return scored(spark, documents, "quality_score", forest, _logits)


def _logits(forest: Forest, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return forest.logits(statistics(data, offsets))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score() of all documents by trees that have seen none of the held-out ones."""
    docs = read(spark, sf_dir, "documents")
    forest = train(spark, docs, read(spark, sf_dir, "labels"))
    scored = score(spark, docs.select("doc_id", "text"), forest)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))

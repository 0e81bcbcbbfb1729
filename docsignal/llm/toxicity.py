"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct words and the four-byte beginnings of its longer words, hashed into 2^18 buckets. The machine is
b + sum w_i + sum over pairs <v_i, v_j>: a pair such as an insult next to the mention of a group can weigh what neither does.
The pairwise sum is half of (sum v)^2 - sum v^2 by factor, so a text costs its number of terms.

Terms are selected in two steps, so that those that tell only as one of a pair are kept: a machine over the terms that go with the
label alone is fitted first; terms of which two together go with what it leaves unexplained are added, and the machine is fitted
again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, U64, crc_mod, mix64, plus, read, span_hashes, text_slices, trim, unused, word_spans

BITS, FACTORS, THRESHOLD = 18, 4, 0.7
#: about so many labelled rows of each label are fitted at most, chosen by a hash of doc_id
MOST_ROWS = 8000
#: a bucket may be used if LEAST_DOCS fitted documents have it; it is if it goes with the label by a chi-square of LEAST_CHI at least,
#: or if one of its pairs goes with the first machine's errors by PAIR_Z deviations and PAIR_DOCS whole documents at least. Pairs are
#: sought among the PAIR_TERMS buckets whose documents have the largest errors together
LEAST_DOCS, LEAST_CHI, PAIR_Z, PAIR_DOCS, PAIR_TERMS = 3, 10.0, 7.0, 6.0, 2048


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every term occurrence."""
    s, e, doc = word_spans(data, offsets, ALNUM)
    h = span_hashes(data, s, e) >> U64(64 - BITS)
    long = e - s >= 6
    p = mix64(span_hashes(data, s[long], s[long] + 4) ^ U64(0x5BF03635)) >> U64(64 - BITS)
    return np.concatenate([doc, doc[long]]), np.concatenate([h, p]).astype(np.int64)


def distinct(doc: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(doc << BITS | bucket)
    return key >> BITS, key & ((1 << BITS) - 1)


@dataclass
class Machine:
    """slot: the parameter row of each bucket, -1 if the bucket is not used."""

    slot: np.ndarray
    b: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        at = self.slot[bucket]
        doc, at = doc[at >= 0], at[at >= 0]
        if not len(at):
            return np.full(n, self.b)
        key = np.unique(doc * len(self.w) + at)
        doc, at = key // len(self.w), key % len(self.w)
        z = self.b + np.bincount(doc, self.w[at], n)
        for f in range(self.v.shape[1]):
            x = self.v[at, f]
            z += 0.5 * (np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n))
        return z


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def paired(rows: list[np.ndarray], error: np.ndarray, most: int = PAIR_TERMS) -> np.ndarray:
    """Buckets of which some pair occurs together where the errors have one sign."""
    mass, df = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for i in range(0, len(rows), 500):
        part, size = np.concatenate(rows[i : i + 500]), [len(r) for r in rows[i : i + 500]]
        mass += np.bincount(part, np.repeat(error[i : i + 500] ** 2, size), 1 << BITS)
        df += np.bincount(part, minlength=1 << BITS)
    # a bucket in nearly all documents pairs with none: its pair is the other bucket
    mass[(df < PAIR_DOCS) | (df > 0.95 * len(rows))] = 0
    top = np.sort(np.argsort(-mass, kind="stable")[:most])
    top = top[mass[top] > 0]
    slot = np.full(1 << BITS, -1, np.int32)
    slot[top] = np.arange(len(top))
    both, spread = np.zeros((len(top), len(top)), np.float32), np.zeros((len(top), len(top)), np.float32)
    for i in range(0, len(rows), 1000):
        part = [slot[r] for r in rows[i : i + 1000]]
        x = np.zeros((len(part), len(top)), np.float32)
        for k, r in enumerate(part):
            x[k, r[r >= 0]] = 1
        e = error[i : i + 1000, None].astype(np.float32)
        both += (x * e).T @ x
        spread += (x * (e * e)).T @ x
    np.fill_diagonal(both, 0)
    hit = (np.abs(both) >= PAIR_DOCS) & (np.abs(both) >= PAIR_Z * np.sqrt(spread))
    return top[hit.any(1)]


def fit(rows: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, factors: int = FACTORS, epochs: int = 60, rate: float = 0.3, l2: float = 1e-5, seed: int = 7) -> Machine:
    """Fit on bucket arrays of documents, see the module; with no rows or one label only, a machine that gives the prior."""
    df, with_label = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for i in range(0, len(rows), 500):
        part, y = np.concatenate(rows[i : i + 500]), np.repeat(labels[i : i + 500], [len(r) for r in rows[i : i + 500]])
        df += np.bincount(part, minlength=1 << BITS)
        with_label += np.bincount(part, y, 1 << BITS)
    mean = float(labels.mean()) if len(labels) else 0.0
    chi = (with_label - df * mean) ** 2 / np.maximum(df * mean * (1 - mean), 1e-9)
    alone = np.flatnonzero((df >= LEAST_DOCS) & (chi >= LEAST_CHI))
    machine = _descend(rows, labels, weight, alone, factors, epochs, rate, l2, seed)
    if not len(rows) or labels.min() == labels.max():
        return machine
    z = [machine.logits(np.repeat(np.arange(len(part)), [len(r) for r in part]), np.concatenate(part), len(part)) for part in (rows[i : i + 500] for i in range(0, len(rows), 500))]
    more = paired(rows, labels - sigmoid(np.concatenate(z)))
    used = np.union1d(alone, more)
    return machine if len(used) == len(alone) else _descend(rows, labels, weight, used, factors, epochs, rate, l2, seed)


def _descend(rows: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, used: np.ndarray, factors: int, epochs: int, rate: float, l2: float, seed: int) -> Machine:
    """AdaGrad over mini-batches for the used buckets."""
    slot = np.full(1 << BITS, -1, np.int32)
    prior = float(np.clip((weight * labels).sum() / max(weight.sum(), 1e-9), 1e-4, 1 - 1e-4)) if len(labels) else 0.01
    b = np.log(prior / (1 - prior))
    slot[used] = np.arange(len(used))
    d = len(used)
    rng = np.random.default_rng(seed)
    w, v = np.zeros(d), rng.normal(0, 0.01, (d, factors))
    if not d or labels.min() == labels.max():
        return Machine(slot, float(b), np.zeros(max(d, 1)), np.zeros((max(d, 1), factors)))
    rows = [a[a >= 0] for a in (slot[r] for r in rows)]
    gw, gv, gb = np.full(d, 1e-6), np.full((d, factors), 1e-6), 1e-6
    weight = weight / weight.mean()
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), 256):
            pick = order[i : i + 256]
            at = np.concatenate([rows[k] for k in pick])
            doc = np.repeat(np.arange(len(pick)), [len(rows[k]) for k in pick])
            if not len(at):
                continue
            n = len(pick)
            x = v[at]
            s = np.stack([np.bincount(doc, x[:, f], n) for f in range(factors)], 1)
            q = np.stack([np.bincount(doc, x[:, f] ** 2, n) for f in range(factors)], 1)
            z = b + np.bincount(doc, w[at], n) + 0.5 * (s * s - q).sum(1)
            err = (sigmoid(z) - labels[pick]) * weight[pick] / n
            here, inv = np.unique(at, return_inverse=True)
            g = np.bincount(inv, err[doc]) + l2 * w[here] * len(pick) / 256
            gw[here] += g * g
            w[here] -= rate * g / np.sqrt(gw[here])
            for f in range(factors):
                g = np.bincount(inv, err[doc] * (s[doc, f] - x[:, f])) + l2 * v[here, f]
                gv[here, f] += g * g
                v[here, f] -= 0.3 * rate * g / np.sqrt(gv[here, f])
            g = err.sum()
            gb += g * g
            b -= rate * g / np.sqrt(gb)
    return Machine(slot, float(b), w, v)


def sample_labels(labels: DataFrame, name: str, mod: int, out: int, most: int) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, label) of about `most` rows a label, and each label's rows for one in the sample.

    Learnt from are labels 0 and 1 whose crc32(doc_id as text) modulo `mod` is not `out`; a hash of doc_id chooses. A doc_id labelled
    twice counts as labelled 1 if one of its rows is.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(name).isin(0, 1) & (crc_mod(F.col("doc_id"), mod) != out))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(name).cast("int").alias("label"))
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    cut = F.when(F.col("label") == 1, F.lit(min(1.0, most / counts.get(1, 1)))).otherwise(F.lit(min(1.0, most / counts.get(0, 1))))
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < cut * (1 << 20)), {y: max(1.0, n / most) for y, n in counts.items()}


def sampled_documents(documents: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, text, label): the sample is bounded, so it is broadcast and documents are scanned once, without a shuffle."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")


def train(spark: SparkSession, documents: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Machine:
    """A machine fitted on about `most` labelled rows of each label. Of documents that share a doc_id one is learnt from, the one whose
    terms come first; unlabelled documents and labels without a document are passed over. Null and empty texts have no terms. With
    empty tables every text gets one score."""
    sample, share = sample_labels(labels, "toxic", 3, 1, most)

    def run(batches):
        for batch in batches:
            out = []
            for i, j, data, off in text_slices(batch.column(1)):
                doc, bucket = distinct(*terms(data, off))
                cut = np.searchsorted(doc, np.arange(j - i + 1))
                out += [bucket[a:b].astype("<i4").tobytes() for a, b in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(2).cast(pa.int32())], names=["doc_id", "terms", "label"])

    rows = sampled_documents(documents, sample).mapInArrow(run, "doc_id long, terms binary, label int")
    got = rows.groupBy("doc_id").agg(F.min("terms").alias("terms"), F.max("label").alias("label")).collect()  # as many rows as the sample
    got.sort(key=lambda r: (r.label, bytes(r.terms)))
    y = np.array([r.label for r in got], float)
    machine = fit([np.frombuffer(r.terms, "<i4") for r in got], y, np.array([share[r.label] for r in got]))
    del got
    trim()
    return machine


def score(spark: SparkSession, documents: DataFrame, machine: Machine) -> DataFrame:
    """documents with one more column, the last: toxic_score, from whole texts; underscores are added where that name is taken.

    A null or empty text gets the score of no terms, rows that are repeated or tie get equal scores, an empty table stays empty. All
    columns stay, whatever their names. A worker holds about 40 bytes for each word of a text beside it.
    """
    return scored(spark, documents, "toxic_score", machine, _logits)


def _logits(machine: Machine, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return machine.logits(*terms(data, offsets), len(offsets) - 1)


def scored(spark: SparkSession, documents: DataFrame, name: str, model, logits) -> DataFrame:
    """documents with the column `name`, or that name with underscores: the sigmoid of logits(model, bytes, offsets) of its texts."""
    cols = documents.columns
    (name,) = unused(cols, name)
    shared = spark.sparkContext.broadcast(model)
    k = cols.index("text")

    def run(batches):
        for batch in batches:
            z = [logits(shared.value, data, off) for _, _, data, off in text_slices(batch.column(k))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigmoid(np.concatenate(z)) if z else [], pa.float64())], names=[*cols, name])

    return documents.mapInArrow(run, plus(documents.schema, (name, T.DoubleType())))


def held_out(mod: int, out: int):
    """A null doc_id is never learnt from and counts as held out."""
    return F.coalesce(crc_mod(F.col("doc_id"), mod) == out, F.lit(True))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score() of all documents by a machine that has seen none of the held-out ones."""
    docs = read(spark, sf_dir, "documents")
    machine = train(spark, docs, read(spark, sf_dir, "labels"))
    scored = score(spark, docs.select("doc_id", "text"), machine)
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"))

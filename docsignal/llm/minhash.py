"""MinHash near-dedup with min-max hashing.

A document's set holds its distinct shingles of five words. Each of PERMS hash functions gives two signature values, the set's
minimum and its maximum, so half the evaluations fill the signature; two sets agree in either value with probability equal to
their Jaccard similarity, and the pair's estimate varies less than that of two independent functions. Signatures are cut into
bands; sets that share a band are candidates, and each candidate link is confirmed on the full sets.

Rows with equal texts form one class, by a SHA-256 of the text; everything after the signatures is done once a class, and texts find
their class by their content, never by an id. Confirmation compares words byte for byte and shingles word for word. The members of a bucket are first tried against one pivot, which settles groups of
copies and near copies at about one comparison a member. In buckets that still hold several components, every member outside the
largest one is then compared with every member, in blocks: a task gets two blocks of texts, counts all common shingles by a matrix
product and returns at most a tree of links. So no pair of different sets that shares a bucket is skipped unless it is connected
already, no task holds a whole bucket, and pairs are never rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, U64, Scratch, components, mix64, read, same_spans, small_batches, span_hashes, text_slices, trim, unused, word_spans

#: near_duplicates and op6 link at LINK_OF_100, deduplicate at NEAR_OF_100 unless told otherwise
WORDS, LINK_OF_100, NEAR_OF_100 = 5, 85, 80
PERMS = 60
#: a pair at the threshold may miss every band with this probability
MISS = 1e-4
#: members compared with one copy of their pivot's text in a task
CHUNK = 128
#: a block has about so many texts, and about so many shingles, at most
BLOCK, BLOCK_SHINGLES = 256, 400_000
#: so many links are joined on the driver, at 16 bytes each; more of them in rounds of tables
DRIVER_LINKS = 1 << 18


def _params() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 2**63, PERMS, dtype=np.uint64) * U64(2) + U64(1), rng.integers(0, 2**63, PERMS, dtype=np.uint64)


A, B = _params()


def banding(link: int) -> tuple[int, int]:
    """(bands, rows a band) for a threshold: the most rows with which a pair at it is missed with probability MISS at most."""
    fit = [r for r in range(1, 2 * PERMS + 1) if 2 * PERMS % r == 0 and (1 - (link / 100) ** r) ** (2 * PERMS // r) <= MISS]
    rows = max(fit, default=1)
    return 2 * PERMS // rows, rows


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each shingle occurrence; a text of 1 to words - 1 words is one shingle."""
    s, e, doc = word_spans(data, offsets, NOT_SPACE)
    h = span_hashes(data, s, e)
    n = len(offsets) - 1
    count = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    out_doc, out = [], []
    m = len(h) - words + 1
    if m > 0:
        ok = doc[:m] == doc[words - 1 :]
        x = np.zeros(m, U64)
        for k in range(words):
            x = x * U64(0x9E3779B97F4A7C55) + h[k : m + k]
        out.append(mix64(x[ok]))
        out_doc.append(doc[:m][ok])
    for d in np.flatnonzero((count > 0) & (count < words)):
        x = np.zeros(1, U64)
        for k in range(count[d]):
            x = x * U64(0x9E3779B97F4A7C55) + h[first[d] + k]
        out.append(mix64(x + U64(int(count[d]) + 1)))
        out_doc.append(np.array([d]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    doc, x = np.concatenate(out_doc), np.concatenate(out)
    order = np.argsort(doc, kind="stable")
    return doc[order], x[order]


def _numbered(x: np.ndarray, same, fallback) -> np.ndarray:
    """Numbers of the rows hashed to x, equal for equal rows only: same(row, first row of its hash) is asked, fallback() numbers a clash."""
    _, first, number = np.unique(x, return_index=True, return_inverse=True)
    return number if same(first[number]) else fallback()


def exact_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The shingle set of each text as numbers that only equal shingles share, word for word and byte for byte."""
    out = [np.zeros(0, np.int64)] * len(texts)
    for i, j, data, off in text_slices(texts, 1 << 62):
        s, e, doc = word_spans(data, off, NOT_SPACE)
        if not len(s):
            continue
        low = LOWER[data]

        def words_by_bytes(low=low, s=s, e=e) -> np.ndarray:
            raw, seen = low.tobytes(), {}
            return np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(s.tolist(), e.tolist(), strict=True)])

        h = span_hashes(low, s, e, fold=False)
        word = _numbered(h, lambda f, low=low, s=s, e=e: same_spans(low, s, e, low, s[f], e[f], fold=False).all(), words_by_bytes)
        count = np.bincount(doc, minlength=j - i)
        first = np.cumsum(count) - count
        # a row of words for each shingle; a short text's missing words are -1
        at = np.flatnonzero(np.arange(len(s)) + words <= (first + count)[doc])
        few = np.flatnonzero((count > 0) & (count < words))
        rows = np.concatenate([word[at[:, None] + np.arange(words)], np.array([[*word[first[d] : first[d] + count[d]], *[-1] * (words - count[d])] for d in few], np.int64).reshape(-1, words)])
        owner = np.concatenate([doc[at], few])
        x = np.zeros(len(rows), U64)
        for k in range(words):
            x = mix64(x * U64(31) + rows[:, k].astype(U64) + U64(2))
        number = _numbered(x, lambda f, rows=rows: bool((rows == rows[f]).all()), lambda rows=rows: np.unique(rows, axis=0, return_inverse=True)[1].ravel())
        order = np.argsort(owner, kind="stable")
        cut = np.searchsorted(owner[order], np.arange(j - i + 1))
        for d in range(j - i):
            out[i + d] = np.unique(number[order[cut[d] : cut[d + 1]]])
    return out


def signature(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Min-max values of the sets x[first[i]:first[i + 1]], PERMS minima and then PERMS maxima; no set is empty."""
    out = np.empty((len(first), 2 * PERMS), U64)
    for p in range(PERMS):
        y = x * A[p] + B[p]
        out[:, p] = np.minimum.reduceat(y, first)
        out[:, PERMS + p] = np.maximum.reduceat(y, first)
    return out


def text_class(text: str = "text"):
    """16 bytes of a SHA-256 of a text."""
    return F.unhex(F.substring(F.sha2(F.col(text), 256), 1, 32))


def signed(documents: DataFrame, link: int = LINK_OF_100) -> DataFrame:
    """(doc_id, class, n, bands): the set's size and the bucket of each band; no bands if the set is empty."""
    n_bands, n_rows = banding(link)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for i, j, data, off in text_slices(batch.column(2)):
                n = j - i
                doc, x = shingles(data, off)
                cut = np.searchsorted(doc, np.arange(n + 1))
                sets = [np.unique(x[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
                size = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(size)
                bands = [None] * n
                if len(full):
                    x = np.concatenate([sets[k] for k in full])
                    first = np.concatenate([[0], np.cumsum(size[full])[:-1]])
                    sig = signature(x, first).reshape(len(full), n_bands, n_rows)
                    key = np.full((len(full), n_bands), 17, U64)
                    for r in range(n_rows):
                        key = mix64(key * U64(31) + sig[:, :, r])
                    key = (key + np.arange(n_bands, dtype=U64)).view(np.int64)
                    for k, row in zip(full, key, strict=True):
                        bands[k] = row
                yield pa.RecordBatch.from_arrays([ids[i:j], batch.column(1)[i:j].cast(pa.binary()), pa.array(size), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "class", "n", "bands"])
        trim()

    return documents.select("doc_id", text_class(), "text").mapInArrow(run, "doc_id long, class binary, n long, bands array<long>")


def _confirm(scratch: Scratch, pairs: DataFrame, texts: DataFrame, link: int, chunk: int) -> DataFrame:
    """Of the class pairs (a: member of size n, b: pivot) those whose full sets are similar enough; texts has (c1, text) of their classes.

    A pivot's members are compared in parts of about `chunk`, or of BLOCK_SHINGLES shingles, each with one copy of the pivot's text,
    so no task holds a whole group.
    """
    parts = F.ceil(F.greatest(F.count("*") / chunk, F.sum("n") / BLOCK_SHINGLES))
    many = scratch.save(pairs.groupBy("b").agg(parts.alias("m")).where("m > 1").withColumnRenamed("b", "b2"), "many")
    sized = pairs.join(many, F.expr("b = b2"), "left").select("a", "b", F.when(F.col("m").isNull(), 0).otherwise(F.pmod(F.xxhash64("a"), F.col("m"))).cast("long").alias("part"))
    want = sized.select("b", "part", F.col("a").alias("c"), F.lit(0).alias("pivot")).union(sized.select("b", "part", F.col("b").alias("c"), F.lit(1).alias("pivot")).distinct())
    rows = want.join(texts, F.expr("c = c1")).select("b", "part", "c", "pivot", "text")

    def run(key, table):
        c, is_pivot = table.column("c").to_pylist(), table.column("pivot").to_pylist()
        sets = exact_sets(table.column("text"))
        pivot, a = sets[is_pivot.index(1)], []
        for k, x in enumerate(sets):
            if not is_pivot[k]:
                both = len(np.intersect1d(pivot, x, assume_unique=True))
                if 100 * both >= link * (len(pivot) + len(x) - both):
                    a.append(c[k])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array([key[0].as_py()] * len(a), pa.int64())})

    return rows.groupBy("b", "part").applyInArrow(run, "a long, b long")


def common(left: list[np.ndarray], right: list[np.ndarray], piece: int = 4096) -> np.ndarray:
    """Common elements of each left and right set, by products of membership matrices over pieces of their elements."""
    both = left + right
    size = np.array([len(x) for x in both])
    values, at = np.unique(np.concatenate(both), return_inverse=True)
    owner = np.repeat(np.arange(len(both)), size)
    shared = np.bincount(at, minlength=len(values)) > 1  # an element of one set only is common to none
    keep = shared[at]
    at, owner = (np.cumsum(shared) - 1)[at[keep]], owner[keep]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(shared.sum()), piece):
        a, b = np.searchsorted(at, [lo, lo + piece])
        m = np.zeros((len(both), piece), np.float32)
        m[owner[a:b], at[a:b] - lo] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out.astype(np.int64)


def _tree(edges: np.ndarray, n: int) -> np.ndarray:
    """Edges that join the same members as edges do, at most n - 1."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = []
    for a, b in edges.tolist():
        x, y = root(a), root(b)
        if x != y:
            up[y] = x
            kept.append((a, b))
    return np.array(kept, np.int64).reshape(-1, 2)


def _compare(scratch: Scratch, rest: DataFrame, texts: DataFrame, link: int, block: int) -> DataFrame:
    """Links (a, b) between the components of each bucket of rest (bucket, c1, n, comp)."""
    parts = rest.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
    major = parts.groupBy("bucket").agg(F.max_by("comp", F.struct("k", "comp")).alias("major"), F.sum("k").alias("m"), F.max("k").alias("k"))
    weight = rest.groupBy("bucket").agg(F.sum("n").alias("w"), F.bit_xor(F.xxhash64("c1")).alias("x"))
    plan = major.join(weight, "bucket")
    # buckets of different bands with the same members need one comparison
    plan = plan.groupBy("m", "x").agg(F.min(F.struct("bucket", "major", "k", "w")).alias("p")).select("m", "p.*")
    all_parts = F.ceil(F.greatest(F.col("m") / block, F.col("w") / BLOCK_SHINGLES)).cast("int")
    plan = plan.withColumn("na", all_parts).withColumn("nm", F.ceil(F.col("na") * (F.col("m") - F.col("k")) / F.col("m")).cast("int"))
    plan = scratch.save(plan.selectExpr("bucket as pb", "major", "na", "nm"), "plan")
    rows = rest.join(plan, F.expr("bucket = pb")).withColumn("minor", F.expr("comp <> major"))
    spot = lambda n: F.pmod(F.xxhash64("c1"), F.col(n)).cast("int")
    left = rows.select("bucket", "c1", "comp", spot("na").alias("i"), F.explode(F.expr("sequence(0, nm - 1)")).alias("j"), F.expr("minor and na = 1").alias("minor"))
    right = rows.where("minor and na > 1").select("bucket", "c1", "comp", F.explode(F.expr("sequence(0, na - 1)")).alias("i"), spot("nm").alias("j"), F.lit(True).alias("minor"))
    sent = left.union(right).withColumnRenamed("c1", "c").join(texts, F.expr("c = c1")).select("bucket", "i", "j", "c", "comp", "minor", "text")

    def run(key, table):
        sets, comp, minor, other = {}, {}, [], []
        for c, k, m, x in zip(table.column("c").to_pylist(), table.column("comp").to_pylist(), table.column("minor").to_pylist(), exact_sets(table.column("text")), strict=True):
            sets[c], comp[c] = x, k
            (minor if m else other).append(c)
        minor, every = sorted(set(minor)), sorted(set(minor) | set(other))
        a = b = np.zeros(0, np.int64)
        if minor and len(every) > 1:
            size = lambda cs: np.array([len(sets[c]) for c in cs])
            both = common([sets[c] for c in minor], [sets[c] for c in every])
            near = 100 * both >= link * (size(minor)[:, None] + size(every)[None] - both)
            near &= np.array([comp[c] for c in minor])[:, None] != np.array([comp[c] for c in every])[None]
            i, j = np.nonzero(near)
            at = {c: k for k, c in enumerate(every)}
            edges = _tree(np.stack([np.array([at[c] for c in minor], np.int64)[i], j], 1), len(every))
            ids = np.array(every, np.int64)
            a, b = ids[edges[:, 0]], ids[edges[:, 1]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return sent.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")


def _joined(spark: SparkSession, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, comp) as components() has them: few links take one small table in place of a table a round, each with a file a partition."""
    if links.count() > DRIVER_LINKS:
        return components(spark, links, scratch, name)
    table = links.toArrow()
    a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    comp, moved = np.arange(len(node)), len(a) > 0
    while moved:
        new, low = comp.copy(), np.minimum(comp[u], comp[v])
        for side in (u, v, comp[u], comp[v]):
            np.minimum.at(new, side, low)
        new = new[new]
        moved, comp = bool((new != comp).any()), new
    return scratch.save(spark.createDataFrame(pa.table({"node": node, "comp": node[comp]}), "node long, comp long"), name)


def _components(spark: SparkSession, documents: DataFrame, link: int, chunk: int, block: int) -> tuple[DataFrame, DataFrame, Scratch]:
    """(signatures of rows, components of classes: (class, component_id, head), scratch).

    head marks the class that stays: the one with the component's least doc_id, of several the least class.
    """
    small_batches(spark)
    scratch = Scratch(spark, "op6")
    sig = scratch.save(signed(documents, link), "signed")
    # c1 is a class's number, fixed by the written table
    classes = sig.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.first("bands").alias("bands"))
    classes = scratch.save(classes.withColumn("c1", F.monotonically_increasing_id()), "classes")
    exploded = classes.select("c1", "n", F.explode("bands").alias("bucket"))
    heads = exploded.groupBy("bucket").agg(F.min(F.struct("c1", "n")).alias("p"), F.count("*").alias("m")).where("m > 1").select("bucket", "p.*", "m").toDF("bucket", "pc", "pn", "m")
    members = scratch.save(exploded.join(heads, "bucket").select("bucket", "c1", "n", "pc", "pn", "m"), "members")
    #: |A and B| <= the smaller size and |A or B| >= the larger
    fits = f"100 * least(n, pn) >= {link} * greatest(n, pn)"
    # one text of each class in some bucket with another one: only these are read again; equal texts meet before the shuffle
    inside = members.select(F.col("c1").alias("c")).distinct().join(classes.select("c1", "class"), F.expr("c = c1")).select("c1", F.col("class").alias("k"))
    texts = documents.select(text_class().alias("class"), "text").groupBy("class").agg(F.first("text").alias("text"))
    texts = scratch.save(texts.join(inside, F.expr("class = k")).select("c1", "text"), "texts", compression="zstd")
    tried = scratch.save(members.where("c1 <> pc").where(fits).select(F.col("c1").alias("a"), F.col("pc").alias("b"), "n").distinct(), "pairs-0")
    links = scratch.save(_confirm(scratch, tried, texts, link, chunk), "links-0")
    comp = _joined(spark, links, scratch, "cc0")
    # buckets that still hold several components
    now = members.join(comp.withColumnRenamed("node", "c1"), "c1", "left").select("bucket", "c1", "n", F.coalesce("comp", "c1").alias("comp"))
    mixed = scratch.save(now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket"), "mixed")
    rest = scratch.save(now.join(mixed, "bucket"), "open")
    more = scratch.save(_compare(scratch, rest, texts, link, block), "links-1")
    if more.limit(1).count():
        comp = _joined(spark, links.union(more), scratch, "cc1")
    label = scratch.save(classes.select("class", "c1", "doc_id").join(comp.withColumnRenamed("node", "c1"), "c1", "left").select("class", "doc_id", F.coalesce("comp", "c1").alias("comp")), "label")
    least = label.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.min_by("class", F.struct(F.col("doc_id").isNull(), "doc_id", "class")).alias("top"))
    final = scratch.save(label.join(least, "comp").select(F.col("class").alias("k"), "component_id", F.expr("class = top").alias("head")), "final")
    scratch.drop("members", "classes", "texts", "open", "pairs-0", "many", "mixed", "plan", "label")
    return sig, final, scratch


def near_duplicates(spark: SparkSession, documents: DataFrame, link: int = LINK_OF_100, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """Per row of documents (doc_id, n_shingles, component_id, kept).

    Null and empty texts have no shingles and link with nothing, not even each other: their component_id is their own doc_id. Equal
    texts and repeated rows are linked; rows that share a doc_id but not a text each have their own links. component_id is the least
    non-null doc_id of the component; a row with null doc_id is kept only if its component has no other id. Other columns, whatever
    their names, are ignored; an empty table gives an empty result. Texts are compared whole, so a task holds the sets of a block
    of texts, or of two very long ones.
    """
    sig, final, _ = _components(spark, documents, link, chunk, block)
    empty = sig.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    full = sig.where("n > 0").join(final, F.expr("class = k")).select("doc_id", "n", "component_id")
    return empty.union(full).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.expr("doc_id <=> component_id").alias("kept"))


def deduplicate(spark: SparkSession, documents: DataFrame, link: int = NEAR_OF_100) -> DataFrame:
    """documents with one row of each component left: one with the least doc_id, and of its rows with different texts the one of least hash.

    Rows without words stay, as they link with nothing. All columns stay, whatever their names; for ties, nulls and empty tables see
    near_duplicates.
    """
    sig, final, scratch = _components(spark, documents, link, CHUNK, BLOCK)
    cls, one, doc, many = unused(documents.columns, "class", "one", "doc", "many")
    heads = sig.where("n > 0").join(final.where("head"), F.expr("class = k and doc_id <=> component_id"))
    heads = scratch.save(heads.groupBy("class", "doc_id").agg(F.count("*").alias("m")).toDF(one, doc, many), "heads")
    rows = documents.withColumn(cls, text_class()).join(heads, F.col(cls).eqNullSafe(F.col(one)) & documents["doc_id"].eqNullSafe(F.col(doc)))
    # of equal rows one stays; there are few where ids are unique, and they meet before the shuffle
    once = rows.where(F.col(many) == 1).unionByName(rows.where(F.col(many) > 1).dropDuplicates([cls, doc])).select(*documents.columns)
    bare = documents.where(F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return once.unionByName(bare)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all documents at 0.85."""
    return near_duplicates(spark, read(spark, sf_dir, "documents"), LINK_OF_100)

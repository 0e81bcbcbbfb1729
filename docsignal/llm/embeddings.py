"""Embedding near-dedup over robust-pruned flat graphs.

Vectors of one label are dealt to the nearest of its cells, several each, so shards overlap. A cell that is too large is split
again, each by centroids of its own bounded sample, so the number of cells follows the data. Centroids within the link distance of
each other count as one: a dense group is not cut, and a cell that gives one centroid only is dense.

Each shard builds a graph: candidates of a vector are pruned robustly (a candidate is dropped if a kept neighbour is closer to it
by the factor ALPHA), and reverse edges are added and pruned again. A vector's adjacency lists from all its shards are united. Then
every shard is searched over the united lists, restricted to its members: greedily from medoids until the beam is stable, and where
the beam holds vectors within the range, on through their neighbours until no more are found. A dense cell of more than MOST_SHARD
nodes is dealt to blocks with a graph each, and every member is searched in the graph of every block. Every link is verified in
double precision.

Equal vectors are one node with a count. A pair of nodes that shares several shards is counted only in the first of them. recall()
audits the links against brute force.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Scratch, components, mix64, read

LINK = 0.93
#: a cell is to hold about CELL nodes of its own; labels of more than WHOLE cells' nodes are split, into FAN cells at most, by
#: PER_CENTROID sampled nodes for each
CELL, WHOLE, FAN, PER_CENTROID = 150, 8, 128, 48
#: a node goes to so many cells at the first split and at later ones, and to no more than half of them; LEVELS splits give FAN ** LEVELS cells
OVERLAP, LATER, LEVELS = 3, 2, 5
MOST_SHARD, DEGREE, ALPHA, BEAM, POOL = 3000, 24, 1.2, 24, 64
#: members that a step of the search goes on from
EXPAND = 8
#: nodes that one task deals to cells at once
CHUNK = 4096


def unit(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths; scaled first, so that no square over- or underflows."""
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), np.finfo(float).tiny)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        some = np.abs(s).sum(1) > 0
        c = np.where(some[:, None], s, c)
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def apart(c: np.ndarray, link: float) -> np.ndarray:
    """Centroids without those within the link distance of an earlier one."""
    kept: list[int] = []
    for i in range(len(c)):
        if not kept or (c[kept] @ c[i]).max() < link:
            kept.append(i)
    return c[kept]


def robust_prune(sim: np.ndarray, points: np.ndarray, pool: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours of each point from its row of the pool (short rows filled with the point), filled with -1: nearest first, without those
    that a chosen one is closer to by the factor alpha. sim holds the cosines of all members."""
    n = len(sim)
    flat = sim.ravel()
    pool = np.take_along_axis(pool, np.argsort(-flat[points[:, None] * n + pool], axis=1, kind="stable"), 1)
    far, alive = 1 - flat[points[:, None] * n + pool], pool != points[:, None]
    out, rows = np.full((len(points), degree), -1), np.arange(len(points))
    for k in range(degree):
        at = alive.argmax(1)
        some = alive[np.arange(len(rows)), at]
        if not some.all():
            rows, pool, far, alive, at = rows[some], pool[some], far[some], alive[some], at[some]
        if not len(rows):
            break
        each = np.arange(len(rows))
        near = pool[each, at]
        out[rows, k] = near
        alive &= alpha * alpha * (1 - flat[near[:, None] * n + pool]) > far  # distances squared, by halves
        alive[each, at] = False
    return out


def build_graph(x: np.ndarray) -> list[np.ndarray]:
    """Adjacency lists of a shard: pruned nearest candidates, then reverse edges, pruned again where too many. The cosines of all members
    are held at once, 72 MB for MOST_SHARD."""
    n = len(x)
    pool = min(POOL, n - 1)
    if n <= 1:
        return [np.zeros(0, np.int64)] * n
    sim = x @ x.T
    np.minimum(sim, 1, out=sim)
    out = []
    for i in range(0, n, 512):
        some = np.arange(i, min(i + 512, n))
        block = sim[some]
        block[some - i, some] = -2
        out.append(robust_prune(sim, some, np.argpartition(block, n - pool, axis=1)[:, n - pool :]))
    out = np.concatenate(out)
    p, q = np.nonzero(out >= 0)[0], out[out >= 0]
    both = np.unique(np.concatenate([p * n + q, q * n + p]))
    p, q = both // n, both % n
    first = np.searchsorted(p, np.arange(n + 1))
    adj, size = np.split(q, first[1:-1]), np.diff(first)
    many = np.flatnonzero(size > DEGREE)
    many = many[np.argsort(size[many], kind="stable")]
    while len(many):  # rows of like length together
        width = min(2 * int(size[many[0]]), int(size[many].max()))
        some = many[: min(512, int(np.searchsorted(size[many], width, "right")))]
        k = np.arange(int(size[some].max()))
        kept = robust_prune(sim, some, np.where(k < size[some, None], q[np.minimum(first[some, None] + k, len(q) - 1)], some[:, None]))
        for i, row in zip(some.tolist(), kept, strict=True):
            adj[i] = row[row >= 0]
        many = many[len(some) :]
    return adj


def range_search(x: np.ndarray, adj: list[np.ndarray], link: float = LINK, others: np.ndarray | None = None, beam: int = BEAM, seeds: int = 4, batch: int = 64) -> np.ndarray:
    """Pairs (i, j), i < j, of members within the range, by greedy search from medoids that goes on through vectors in range; with
    `others`, pairs (i, j) of other vectors i and members j."""
    n, queries = len(x), x if others is None else others
    if not n:
        return np.zeros((0, 2), np.int64)
    width = max(1, max((len(a) for a in adj), default=1))
    table = np.full((n, width), n)
    for p, a in enumerate(adj):
        table[p, : len(a)] = a
    # the medoid and the members that a farthest-first walk from it meets
    start = [int((x @ x.mean(0)).argmax())]
    far = x @ x[start[0]]
    while len(start) < min(seeds, n):
        start.append(int(far.argmin()))
        far = np.maximum(far, x @ x[start[-1]])
    found, step, beam = [], min(EXPAND, n), min(beam, n)
    mark = np.zeros(min(batch, len(queries)) * (n + 1), np.int32)
    for i in range(0, len(queries), batch):
        mine = queries[i : i + batch]
        m = len(mine)
        far = np.full((m, n + 1), 2.0)  # cosines of visited members, negated
        far[:, start] = -(mine @ x[start].T)
        fresh = far.copy()  # of those not gone on from yet
        seen = np.zeros((m, n + 1), bool)
        seen[:, start] = True
        seen[:, n] = True
        rows = np.arange(m)
        while len(rows):
            some = slice(None) if len(rows) == m else rows
            cand = fresh[some]
            best = np.argpartition(cand, step - 1, axis=1)[:, :step]
            top = np.take_along_axis(cand, best, 1)
            # the beam's last place among the visited
            kth = np.partition(far[some], beam - 1, axis=1)[:, beam - 1]
            on = (top < 2) & ((top <= kth[:, None]) | (top <= -link))
            go = on.any(1)
            rows, best, on = rows[go], best[go], on[go]
            if not len(rows):
                break
            r, c = np.nonzero(on)
            base, c = rows[r] * (n + 1), best[r, c]
            fresh.ravel()[base + c] = 2
            near = (base[:, None] + table[c]).ravel()
            near = near[~seen.ravel()[near]]
            k = np.arange(len(near), dtype=np.int32)
            mark[near] = k
            near = near[mark[near] == k]  # each member once a query
            seen.ravel()[near] = True
            rr, nn = np.divmod(near, n + 1)
            far.ravel()[near] = fresh.ravel()[near] = -np.einsum("ij,ij->i", mine[rr], x[nn])
        a, b = np.nonzero(far[:, :n] <= 1e-6 - link)
        a += i
        if others is None:
            a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
        found.append(a * n + b)
    pairs = np.stack(np.divmod(np.unique(np.concatenate(found)), n), 1) if found else np.zeros((0, 2), np.int64)
    return pairs[np.einsum("ij,ij->i", queries[pairs[:, 0]], x[pairs[:, 1]]) >= link]


def forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """Edges that join the same members as pairs do, at most n - 1 of them."""
    up = np.arange(n)
    while len(pairs):
        np.minimum.at(up, pairs[:, 1], up[pairs[:, 0]])
        np.minimum.at(up, pairs[:, 0], up[pairs[:, 1]])
        new = up[up]
        if (new == up).all() and (up[pairs[:, 0]] == up[pairs[:, 1]]).all():
            break
        up = new
    i = np.flatnonzero(up != np.arange(n))
    return np.stack([up[i], i], 1)


def first_common(cells: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """The least cell that rows a and b of the table of cells (short rows filled with their last cell) share, for each pair."""
    out = np.zeros(len(a), np.int64)
    for i in range(0, len(a), step):
        x, y = cells[a[i : i + step]], cells[b[i : i + step]]
        shared = (x[:, :, None] == y[:, None, :]).any(2)
        out[i : i + step] = np.where(shared, x, np.iinfo(np.int64).max).min(1)
    return out


def _matrix(column) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(a), -1)


def _cells(column) -> np.ndarray:
    """Lists of cells as a table, short ones filled with their last."""
    lists = column.to_pylist()
    width = max(map(len, lists), default=1)
    return np.array([x + x[-1:] * (width - len(x)) for x in lists], np.int64).reshape(len(lists), width)


def usable_rows(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, dim, key, vec) of each row that can link: key names the vector's components, -0.0 as 0.0, by 128 bits."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    good = F.expr("size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("vec")).where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).where(good)
    rows = rows.select("vec_id", "label", F.size("vec").alias("dim"), F.transform("vec", lambda x: x + F.lit(0.0)).alias("vec"))

    def run(batches):
        for batch in batches:
            vec, dims = batch.column(3), batch.column(2).to_numpy()
            flat, at = vec.flatten().to_numpy(zero_copy_only=False), np.cumsum(dims) - dims
            keys = [hashlib.blake2b(flat[a : a + n].tobytes(), digest_size=16).digest() for a, n in zip(at.tolist(), dims.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(keys, pa.binary()), vec], names=["vec_id", "label", "dim", "key", "vec"])

    return rows.mapInArrow(run, f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, dim int, key binary, vec array<double>")


CELL_KEY = ["label", "dim", "cell"]


def split(scratch: Scratch, held: DataFrame, big: DataFrame, level: int, link: float, cell: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """Of the members held (label, dim, cell, node, vec) of the cells big (label, dim, cell, count): (members of the cells they are split
    into, cells that are dense and stay)."""
    fan = F.least(F.lit(FAN), F.ceil(F.col("count") / cell))
    want = big.withColumn("fan", fan).select(*[F.col(c).alias(f"b_{c}") for c in CELL_KEY], "count", "fan")
    on = F.expr(" and ".join(f"{c} = b_{c}" for c in CELL_KEY))
    mine = held.join(want, on).drop(*[f"b_{c}" for c in CELL_KEY])
    share = F.col("fan") * PER_CENTROID / F.col("count")
    sample = mine.where(F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 20)) < share * (1 << 20))
    label = held.schema["label"].dataType.simpleString()

    def centroids(key, table):
        order = np.argsort(table.column("node").to_numpy())
        x = unit(_matrix(table.column("vec").take(pa.array(order))))
        c = apart(kmeans(x, min(int(table.column("fan")[0].as_py()), len(x))), link)
        return pa.table({"label": table.column("label").slice(0, 1), "dim": pa.array([key[1].as_py()], pa.int32()), "cell": pa.array([key[2].as_py()], pa.int64()), "n": pa.array([len(c)], pa.int64()), "flat": pa.array([c.ravel()], pa.list_(pa.float64()))})

    found = scratch.save(sample.groupBy(*CELL_KEY).applyInArrow(centroids, f"label {label}, dim int, cell long, n long, flat array<double>"), f"centroids{level}")
    dense = found.where("n < 2").select(*CELL_KEY)
    # a part of a cell's members comes with one copy of its centroids
    many = found.where("n > 1").join(want, on).drop(*[f"b_{c}" for c in CELL_KEY]).withColumn("parts", F.ceil(F.col("count") / CHUNK).cast("int"))
    live = mine.join(many.select(*[F.col(c).alias(f"b_{c}") for c in CELL_KEY], "parts"), on).drop(*[f"b_{c}" for c in CELL_KEY])
    rows = live.select(*CELL_KEY, F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node", "vec")
    rows = rows.union(many.select(*CELL_KEY, F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.lit(None).cast("long").alias("node"), F.col("flat").alias("vec")))

    def assign(key, table):
        ids = table.column("node").combine_chunks()
        is_node = ids.is_valid().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(is_node)
        if not len(at):
            return table.slice(0, 0).select([*CELL_KEY, "node", "vec"])
        c = np.array(table.column("vec")[int(np.flatnonzero(~is_node)[0])].as_py()).reshape(-1, key[1].as_py())
        here = table.take(pa.array(at))
        near = np.argsort(-(unit(_matrix(here.column("vec"))) @ c.T), axis=1, kind="stable")[:, : max(1, min(overlap, len(c) // 2))]
        take = pa.array(np.repeat(np.arange(len(at)), near.shape[1]))
        sub = mix64(np.full(near.size, key[2].as_py(), np.int64).view(U64) * U64(31) + near.ravel().astype(U64) + U64(1)).view(np.int64)
        out = here.take(take)
        return pa.table({"label": out.column("label"), "dim": out.column("dim"), "cell": pa.array(sub), "node": out.column("node"), "vec": out.column("vec")})

    dealt = rows.groupBy(*CELL_KEY, "part").applyInArrow(assign, f"label {label}, dim int, cell long, node long, vec array<double>")
    return dealt, dense


def deal(scratch: Scratch, points: DataFrame, link: float, cell: int, overlap: int, most_shard: int) -> tuple[DataFrame, DataFrame]:
    """(members of cells (label, dim, cell, node, vec), counts of the dense cells over most_shard (label, dim, cell, count)).

    Labels are the first cells. A table is written for each level; there are as many as the logarithm of the largest label.
    """
    open_ = points.select("label", "dim", F.lit(0).cast("long").alias("cell"), "node", "vec")
    done, large = None, None
    for level in range(LEVELS):
        counts = scratch.save(open_.groupBy(*CELL_KEY).count(), f"counts{level}")
        big = counts.where(F.col("count") > (min(WHOLE * cell, most_shard) if level == 0 else most_shard))
        if not big.limit(1).count():
            break
        dealt, dense = split(scratch, open_, big, level, link, cell, overlap if level == 0 else min(LATER, overlap))
        dealt = scratch.save(dealt.distinct() if level else dealt, f"level{level}")
        stay = open_.join(big.join(dense, CELL_KEY, "left_anti").select(*CELL_KEY), CELL_KEY, "left_anti").select(*open_.columns)
        done = stay if done is None else done.union(stay)
        more = counts.join(dense, CELL_KEY, "left_semi").where(F.col("count") > most_shard)
        large = more if large is None else large.union(more)
        open_ = dealt
    else:
        counts = scratch.save(open_.groupBy(*CELL_KEY).count(), "counts-last")
        more = counts.where(F.col("count") > most_shard)
        large = large.union(more)
    done = open_ if done is None else done.union(open_)
    return done, scratch.save(large if large is not None else counts.where("false"), "large")


LINKS = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])


def _links(ids: np.ndarray, many: np.ndarray, cells: np.ndarray, cell: int, pairs: np.ndarray) -> pa.Table:
    """Link counts of the pairs whose first common cell this is, and a forest that joins all."""
    own = pairs[first_common(cells, pairs[:, 0], pairs[:, 1]) == cell]
    n = np.bincount(own[:, 0], many[own[:, 1]], len(ids)) + np.bincount(own[:, 1], many[own[:, 0]], len(ids))
    edge, some = forest(pairs, len(ids)), np.flatnonzero(n)
    return pa.Table.from_arrays([pa.array(np.concatenate([ids[some], ids[edge[:, 1]]])), pa.array(np.concatenate([n[some].astype(np.int64), np.zeros(len(edge), np.int64)])), pa.array(np.concatenate([ids[some], ids[edge[:, 0]]]))], schema=LINKS)


def _table(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(ids, counts, cells, unit vectors, adjacency within the table) of the rows, which come in the order of their ids."""
    ids = table.column("node").to_numpy()
    near = table.column("near").combine_chunks()
    flat, size = near.flatten().to_numpy(zero_copy_only=False), near.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
    inside = ids[at] == flat
    owner = np.repeat(np.arange(len(ids)), size)[inside]
    adj = np.split(at[inside], np.searchsorted(owner, np.arange(1, len(ids))))
    return ids, table.column("many").to_numpy(), _cells(table.column("cells")), unit(_matrix(table.column("vec"))), adj


def near_duplicates(spark: SparkSession, embeddings: DataFrame, link: float = LINK, overlap: int = OVERLAP, most_shard: int = MOST_SHARD, cell: int = CELL) -> DataFrame:
    """Per row of embeddings (vec_id, n_links, component_id, kept).

    Only vectors with equal labels, both not null, and equal dimensions link. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows with null vec_id, link with nothing: n_links 0 and their own vec_id as component_id. Equal
    vectors link with each other. Rows with one vec_id repeated share their nodes' component; their links count once for each row.
    Other columns, whatever their names, are ignored; an empty table gives an empty result. The links found are true ones, but the
    search may miss some: see recall().
    """
    scratch = Scratch(spark, "op4")
    rows = scratch.save(usable_rows(embeddings), "rows")
    points = rows.groupBy("label", "dim", "key").agg(F.min("vec_id").alias("node"), F.count("*").alias("many"), F.first("vec").alias("vec"))
    points = scratch.save(points, "nodes")
    members, large = deal(scratch, points, link, cell, overlap, most_shard)
    members = members.select(*CELL_KEY, "node", "vec")
    lists = members.groupBy("node").agg(F.array_sort(F.collect_set("cell")).alias("cells")).select(F.col("node").alias("c_node"), "cells")
    info = points.select(F.col("node").alias("i_node"), "many").join(lists, F.expr("i_node = c_node")).drop("c_node")
    on = F.expr(" and ".join(f"{c} = b_{c}" for c in CELL_KEY))
    blocks = large.select(*[F.col(c).alias(f"b_{c}") for c in CELL_KEY], F.ceil(F.col("count") / max(1, most_shard // 2)).cast("int").alias("parts"))
    shards = members.join(F.broadcast(blocks) if blocks.limit(10_001).count() <= 10_000 else blocks, on, "left").drop(*[f"b_{c}" for c in CELL_KEY])
    shards = shards.select(*CELL_KEY, F.coalesce("parts", F.lit(1)).alias("parts"), "node", "vec")
    shards = shards.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    shards = scratch.save(shards.join(info, F.expr("node = i_node")).drop("i_node"), "dealt")

    def graph(table):
        ids = table.column("node").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        adj = build_graph(unit(_matrix(table.column("vec").take(pa.array(order)))))
        return pa.table({"g": pa.array(ids), "near": pa.array([ids[a] for a in adj], pa.list_(pa.int64()))})

    lists = shards.groupBy(*CELL_KEY, "part").applyInArrow(graph, "g long, near array<long>")
    united = scratch.save(lists.groupBy("g").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "adjacency")
    part = shards.join(united, F.expr("node = g"), "left").drop("g")
    result = "node long, n long, root long"

    def search(key, table):
        ids, many, cells, x, adj = _table(table.take(pa.array(np.argsort(table.column("node").to_numpy()))))
        return _links(ids, many, cells, key[2].as_py(), range_search(x, adj, link))

    found = scratch.save(part.where("parts = 1").groupBy(*CELL_KEY).applyInArrow(search, result), "found")
    if blocks.limit(1).count():
        # block j has the graph, the members of block i are searched in it
        meet = part.where("parts > 1").withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).select("*", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))

        def across(key, table):
            table = table.take(pa.array(np.argsort(table.column("node").to_numpy())))
            block, i, j = table.column("part").to_numpy(), key[3].as_py(), key[4].as_py()
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            if not len(left) or not len(right):
                return LINKS.empty_table()
            _, _, _, x, adj = _table(table.take(pa.array(right)))
            pairs = range_search(x, adj, link, None if i == j else unit(_matrix(table.column("vec").take(pa.array(left)))))
            pairs = np.stack([left[pairs[:, 0]], right[pairs[:, 1]]], 1)
            return _links(table.column("node").to_numpy(), table.column("many").to_numpy(), _cells(table.column("cells")), key[2].as_py(), pairs)

        found = found.union(scratch.save(meet.groupBy(*CELL_KEY, "i", "j").applyInArrow(across, result), "across"))
    comp = components(spark, found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    sums = found.groupBy("node").agg(F.sum("n").alias("n"))
    final = points.join(sums, "node", "left").join(comp, "node", "left").select(F.col("label").alias("l"), F.col("dim").alias("d"), F.col("key").alias("k"), (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("comp", "node").alias("component_id"))
    linked = rows.select("vec_id", "label", "dim", "key").join(final, F.expr("label = l and dim = d and key = k")).select("vec_id", "n_links", "component_id")
    linked = scratch.save(linked, "linked")
    scratch.drop("nodes", "dealt", "adjacency", "found", "across", "large", *(f"{n}{k}" for n in ("counts", "centroids", "level") for k in range(LEVELS)))
    # rows that cannot link stand alone
    alone = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").where(~_usable_sql())
    alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.expr("vec_id <=> component_id"))


def _usable_sql():
    """Whether a row (vec_id, label, embedding) is one of usable_rows."""
    good = "size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    return F.coalesce(F.expr(f"vec_id is not null and label is not null and embedding is not null and {good}"), F.lit(False))


def recall(embeddings: DataFrame, result: DataFrame, link: float = LINK, every: int = 100, block: int = 2000) -> tuple[int, int]:
    """(links found, true links) of the rows whose vec_id is divisible by `every`, against all rows by brute force in blocks of queries."""
    rows = embeddings.where(_usable_sql()).select("vec_id", "label", F.size("embedding").alias("dim"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    queries = rows.where(F.col("vec_id") % every == 0)
    blocks, truth = -(-queries.count() // block), 0
    for k in range(blocks):
        got = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == k).collect()  # about `block` rows
        own: dict = {}
        for r in got:
            own.setdefault((r.label, r.dim), []).append((r.vec_id, r.vec))
        own = {key: (np.array([v for v, _ in rs]), unit(np.array([x for _, x in rs]))) for key, rs in own.items()}

        def run(batches, own=own):
            for batch in batches:
                n, ids, labels, dims = 0, batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
                where: dict = {}
                for i, key in enumerate(zip(labels, dims.tolist(), strict=True)):
                    where.setdefault(key, []).append(i)
                for key, at in where.items():
                    if key in own:
                        q, x = own[key]
                        near = x @ unit(_matrix(batch.column(3).take(pa.array(at)))).T >= link
                        n += int((near & (q[:, None] != ids[at][None])).sum())
                yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

        truth += rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
    got = result.where(F.col("vec_id") % every == 0).agg(F.sum("n_links")).first()[0] or 0
    return got, truth


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all embeddings."""
    return near_duplicates(spark, read(spark, sf_dir, "embeddings"))

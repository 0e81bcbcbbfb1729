"""Mixing sources to target weights by Pareto order sampling; DataFrame and SQL functions only.

Targets: the sources share `share` times all words by their weights; none passes `most` times its own words, and the excess goes
to the others (a water level over sources ordered by cap / weight). Within a source the expected copies of a document go by its
inclusion weight, and are cut at `most` in the same way; unless a column gives the weights, a document weighs the number of binary
digits of its size, so that longer texts are likelier. The whole part of the expected copies is allocated for certain, the rest p
is its inclusion probability. Documents are ranked by (u / (1 - u)) / (p / (1 - p)) with u from a hash of the document, and the
first ones whose words fill the source's remaining quota are taken: the sample's size is fixed in words, the sum of p times size.
Whole documents leave a gap, smaller than the first document that did not fit. Where it is over SLACK of the target, as in small
sources, of the next FILL documents in rank order that are no larger than the gap each is taken that still fits, until no more than
that is left; this favours short documents, so larger sources have none of it.

The cut is found by counting words in bins of the rank and then sorting the rows of the one bin that holds it: no source is ever
sorted or gathered as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read, unused

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2
#: a source's cut is sought in one of BINS bins; FILL documents after it are tried for a gap of over SLACK of the target
BINS, FILL, SLACK = 1024, 200, 0.005
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, size): one row a source, in code point order, null last.

    Sources in the order of cap / weight reach their cap first; what is left by those goes by weight to the rest.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below, whole = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    t = per.withColumn("weight", pick).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    t = t.withColumn("unit", (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("weight").over(whole))
    t = t.withColumn("open", F.when(F.col("unit") * F.col("weight") <= F.col("cap"), F.col("unit")))
    t = t.withColumn("rank", F.row_number().over(level)).withColumn("from", F.min(F.when(F.col("open").isNotNull(), F.col("rank"))).over(every))
    t = t.withColumn("water", F.max(F.when(F.col("rank") == F.col("from"), F.col("unit"))).over(every))
    return t.select("source", "source_size", F.when(F.col("rank") >= F.col("from"), F.least("cap", F.col("water") * F.col("weight"))).otherwise(F.col("cap")).alias("target"))


def uniform(seed: int, *cols: str):
    """In (0, 1), the same in every run: 52 bits of a hash of the columns' texts."""
    text = F.concat_ws("\x1f", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def copy_rates(masses: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """(key, w, rate): the expected copies of a source's documents of each inclusion weight, rate = least(most, level * w).

    masses: (source, w, words), a row for each weight that a source has; they are few, as weights are whole numbers or rounded. The
    largest weights reach the cap first; the level gives the rest what is left of the target.
    """
    t = masses.join(targets.select(F.col("source").alias("key"), "target"), F.expr("source <=> key"))
    down = Window.partitionBy("key").orderBy(F.desc("w"))
    above, rest, every = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy("key")
    t = t.withColumn("level", F.try_divide(F.col("target") - most * F.coalesce(F.sum("words").over(above), F.lit(0)), F.sum(F.col("w") * F.col("words")).over(rest)))
    t = t.withColumn("open", F.max(F.when(F.col("level") * F.col("w") <= most, F.struct("w", "level"))).over(every))
    rate = F.when(F.col("w") <= F.col("open.w"), F.greatest(F.lit(0.0), F.col("open.level") * F.col("w"))).otherwise(F.lit(float(most)))
    return t.select("key", "w", F.when(F.col("target") > 0, rate).otherwise(F.lit(0.0)).alias("rate"), "words", "target")


def uniform(seed: int, *cols: str):
    """In (0, 1), the same in every run: 52 bits of a hash of the columns' texts."""
    text = F.concat_ws("\x1f", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def _cuts(scratch: Scratch, live: DataFrame, quotas: DataFrame, bins: int, fill: int, small) -> tuple[DataFrame, DataFrame]:
    """(key, cut): the rank (s, tie) of each source's first document that does not fit, null if all do; and (key, tie) of the documents
    that fill its gap.

    live: (key, size, s, tie), quotas: (key, quota, slack). Rows of equal rank are one unit.
    """
    spot = F.least(F.floor(F.col("s") * bins), F.lit(bins - 1))
    up = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = live.groupBy("key", spot.alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    sums = sums.withColumn("upto", F.sum("words").over(up)).withColumn("seen", F.sum("rows").over(up))
    q = quotas.withColumnRenamed("key", "k")
    sums = scratch.save(sums.join(small(q), F.expr("key <=> k")).drop("k"), "bins")
    over = F.when(F.col("upto") > F.col("quota"), F.struct("bin", (F.col("upto") - F.col("words")).alias("before"), (F.col("seen") - F.col("rows")).alias("seen")))
    first = sums.groupBy("key").agg(F.max("quota").alias("quota"), F.max("slack").alias("slack"), F.min(over).alias("c")).where("c is not null").select("key", "quota", "slack", "c.*")
    # the bins after the cut's that hold documents enough to fill the gap
    near = sums.join(small(first.select(F.col("key").alias("k"), F.col("bin").alias("b0"), F.col("seen").alias("n0"))), F.expr("key <=> k and bin >= b0 and (bin <= b0 + 1 or seen - rows <= n0 + %d)" % (2 * fill)))
    first = scratch.save(first.join(near.groupBy("k").agg(F.max("bin").alias("last")), F.expr("key <=> k")).select(F.col("key").alias("k"), "quota", "slack", "bin", "last", "before"), "edges")
    rows = live.join(small(first), F.expr("key <=> k")).where(spot.between(F.col("bin"), F.col("last")))
    units = rows.groupBy("key", "s", "tie").agg(F.sum("size").alias("size"), F.max("quota").alias("quota"), F.max("slack").alias("slack"), F.max("before").alias("before"))
    order = Window.partitionBy("key").orderBy("s", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    units = scratch.save(units.withColumn("upto", F.col("before") + F.sum("size").over(order)), "edge")
    cut = units.where("upto > quota").groupBy("key").agg(F.min(F.struct("s", "tie", (F.col("quota") - F.col("upto") + F.col("size")).alias("gap"))).alias("c"))
    cut = scratch.save(cut.select(F.col("key").alias("k"), F.struct("c.s", "c.tie").alias("cut"), F.col("c.gap").alias("gap")), "cut")
    after = units.join(small(cut), F.expr("key <=> k")).where(F.struct("s", "tie") >= F.col("cut")).where("size <= gap and gap > slack")
    after = after.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("s", "tie"))).where(F.col("r") <= fill)
    lists = after.groupBy("key").agg(F.max("gap").alias("gap"), F.max("slack").alias("slack"), F.array_sort(F.collect_list(F.struct("r", "size", "tie"))).alias("list"))
    start = F.struct(F.col("gap").alias("left"), F.array().cast("array<int>").alias("got"))
    step = lambda a, x: F.when((x["size"] <= a["left"]) & (a["left"] > F.col("slack")), F.struct((a["left"] - x["size"]).alias("left"), F.concat(a["got"], F.array(x["r"])).alias("got"))).otherwise(a)
    picked = lists.select("key", "list", F.aggregate("list", start, step)["got"].alias("got"))
    picked = picked.select("key", F.explode(F.filter("list", lambda x: F.array_contains("got", x["r"])))).select(F.col("key").alias("k2"), F.col("col.tie").alias("tie2"))
    return cut.drop("gap"), scratch.save(picked, "filled")


def mix(spark: SparkSession, documents: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS, seed: int = 1, weight: str | None = None, bins: int = BINS, fill: int = FILL) -> DataFrame:
    """Per document (doc_id, source, text_hash, size, source_size, target, taken, copies); see the module.

    `weight` names a column of inclusion weights instead of the size's digits; they are rounded to an eighth of a power of two, null,
    not finite or not positive ones count as 0. Null texts have size 0 and take nothing, null sources form one source, the last.
    Rows equal in doc_id, source and text share a rank and are taken or left together; other ties cannot be. Rows with null doc_id
    are ranked by their text. Other columns, whatever their names, are ignored. An empty table gives an empty mix. Reruns agree.
    Texts are counted whole, by the JVM. The table of sources, one row each, is ordered in one task.
    """
    scratch = Scratch(spark, "op5")
    if weight:
        given = F.col(weight).cast("double")
        w = F.when((given > 0) & (given < float("inf")), F.pow(F.lit(2.0), F.round(F.log2(given) * 8) / 8)).otherwise(F.lit(0.0))
    else:
        w = F.length(F.bin(size_of())).cast("double")
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.md5("text"), F.lit("")).alias("text_hash"), size_of().alias("size"), w.alias("w"))
    base = scratch.save(base, "sizes")
    masses = scratch.save(base.groupBy("source", "w").agg(F.sum("size").alias("words")), "masses")
    targets = scratch.save(source_targets(masses.select("source", F.col("words").alias("size")), share, most, weights), "targets")
    rates = scratch.save(copy_rates(masses, targets, float(most)).withColumn("whole", F.floor(F.col("rate") + 1e-12)), "rates")
    few = rates.limit(100_001).count() <= 100_000  # rows of a source and weight: broadcast if there are few of them, shuffle if not
    small = F.broadcast if few else (lambda df: df)
    quotas = rates.groupBy("key").agg(F.greatest(F.lit(0), F.floor(F.max("target") + 0.5) - F.sum(F.col("whole") * F.col("words"))).cast("long").alias("quota"), F.floor(F.max("target") * SLACK).alias("slack"))
    t = rates.select("key", F.col("w").alias("w2"), "rate", "whole")
    rows = base.join(small(t), F.expr("source <=> key and w = w2")).drop("source", "w2", "w").withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    rows = rows.withColumn("u", uniform(seed, "doc_id", "text_hash")).withColumn("tie", F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), "text_hash"))
    odds = F.col("u") / (1 - F.col("u")) * (1 - F.col("p")) / F.col("p")
    rows = rows.withColumn("s", F.when((F.col("p") > 1e-12) & (F.col("size") > 0), odds / (1 + odds)))
    rows = scratch.save(rows.drop("u", "rate", "p"), "ranked")
    cut, filled = _cuts(scratch, rows.where("s is not null").select("key", "size", "s", "tie"), quotas, bins, fill, small)
    out = rows.join(small(cut), F.expr("key <=> k"), "left").join(small(filled) if few else filled, F.expr("key <=> k2 and tie = tie2"), "left")
    got = F.col("s").isNotNull() & (F.col("cut").isNull() | (F.struct("s", "tie") < F.col("cut")) | F.col("tie2").isNotNull())
    out = out.withColumn("copies", (F.col("whole") + got.cast("int")).cast("int"))
    t = targets.withColumnRenamed("source", "from")
    out = out.join(small(t), F.expr("key <=> from")).select("doc_id", F.col("key").alias("source"), "text_hash", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")
    scratch.drop("sizes", "masses", "bins", "edges", "edge")
    return out


def apply_mix(documents: DataFrame, mixed: DataFrame) -> DataFrame:
    """documents with each row repeated as often as the mix takes it. All columns stay, whatever their names; rows equal in doc_id, source
    and text are taken alike; a row with null doc_id, source or text finds its own row of the mix."""
    doc, source, text, n, copy = unused(documents.columns, "doc", "from", "hash", "many", "copy")
    m = mixed.where("copies > 0").groupBy(F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("text_hash").alias(text)).agg(F.max("copies").alias(n))
    same = documents["doc_id"].cast("long").eqNullSafe(F.col(doc)) & documents["source"].cast("string").eqNullSafe(F.col(source)) & (F.coalesce(F.md5(documents["text"]), F.lit("")) == F.col(text))
    return documents.join(m, same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*documents.columns)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix() of all documents."""
    return mix(spark, read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")

"""The relational end of a scan: union, dedup, rules, calibration by domain rarity, threshold, order, summaries.

Findings carry a column `seq` that says in which order they were made; any orderable type will do.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import domain, suffixes
from ..vocab import BENIGN_DOMAINS, RANK, RARITY

#: rules up to this number are broadcast; more are joined by shuffle
MOST_RULES = 50_000
LINKS = ["active_url", "tracking_pixel"]


def rank(severity: Column) -> Column:
    """0 info to 4 critical; an unknown severity ranks as info."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in RANK.items() for x in p]), severity), F.lit(0))


def union_all(stages: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stages)


KEY = ["file", "category", "subcategory", "evidence"]


def dedup(findings: DataFrame) -> DataFrame:
    """One row a key: the most severe, then the surest, then the first made; at the place of the key's first row.

    min_by keeps one candidate a key before the shuffle, so a key with many rows costs no more than others.
    """
    rest = [c for c in findings.columns if c not in (*KEY, "seq")]
    order = F.struct((-rank(F.col("severity"))).alias("rank"), (-F.col("confidence")).alias("confidence"), "seq")
    best = findings.groupBy(*KEY).agg(F.min_by(F.struct(*rest), order).alias("_best"), F.min("seq").alias("seq"))
    return best.select(*[F.col(c) if c in (*KEY, "seq") else F.col(f"_best.{c}") for c in findings.columns])


def evidence_domain(strict_host: bool = False) -> Column:
    """Domain of a link finding, else null."""
    return F.when(F.col("category").isin(LINKS) & (F.col("evidence") != ""), domain(F.col("evidence"), strict_host))


def domain_files(findings: DataFrame, strict_host: bool = False) -> DataFrame:
    """(domain, n_files): distinct files by domain, over all link findings; the same before and after dedup, whose key holds what it counts."""
    return findings.select("file", evidence_domain(strict_host).alias("domain")).where("domain is not null").groupBy("domain").agg(F.count_distinct("file").alias("n_files"))


@dataclass
class Rules:
    """Allow and deny lists. domains match whole, by ending or as *.ending; metadata maps a subcategory to values."""

    domains: list[str] = field(default_factory=list)
    urls: list[str] = field(default_factory=list)
    files: list[str] = field(default_factory=list)
    metadata: dict[str, list[str]] = field(default_factory=dict)


def _table(spark: SparkSession, values: list[str], name: str) -> DataFrame:
    rows = sorted(set(values))
    table = spark.createDataFrame([(v,) for v in rows], f"{name} string")
    return F.broadcast(table) if len(rows) <= MOST_RULES else table


def _flag(spark: SparkSession, df: DataFrame, values: list[str], column: str, flag: str) -> DataFrame:
    """df with a boolean column: whether `column` is one of the values."""
    if not values:
        return df.withColumn(flag, F.lit(False))
    t = _table(spark, values, f"_{flag}")
    return df.join(t, F.col(column) == F.col(f"_{flag}"), "left").withColumn(flag, F.col(f"_{flag}").isNotNull()).drop(f"_{flag}")


def domain_flags(spark: SparkSession, domains: DataFrame, lists: dict[str, list[str]]) -> DataFrame:
    """domains with a boolean column for each list: whether a pattern of it is the domain, an ending of it, or * and an ending."""
    rows = [(p.removeprefix("*."), k) for k, ps in lists.items() for p in set(ps)] + [(p, k) for k, ps in lists.items() for p in set(ps) if p.startswith("*.")]
    if not rows:
        return domains.select("*", *[F.lit(False).alias(k) for k in lists])
    rules = spark.createDataFrame(rows, "suffix string, list string")
    rules = F.broadcast(rules) if len(rows) <= MOST_RULES else rules
    ends = domains.select("*", F.explode_outer(suffixes(F.col("domain"))).alias("suffix")).join(rules, "suffix", "left")
    return ends.groupBy(*domains.columns).agg(*[F.coalesce(F.max(F.col("list") == k), F.lit(False)).alias(k) for k in lists])


def calibrated(n: Column, confidence: Column) -> tuple[Column, Column]:
    """Severity (null: as it was) and confidence of a link whose domain is in n distinct files."""
    sev, conf = F.lit(None).cast("string"), confidence
    for most, severity, step, bound in reversed(RARITY):
        value = F.least(F.lit(bound), confidence + step) if step > 0 else F.greatest(F.lit(bound), confidence + step) if step else confidence
        inside = F.lit(True) if most is None else n <= most
        sev, conf = F.when(inside, F.lit(severity)).otherwise(sev), F.when(inside, value).otherwise(conf)
    return sev, conf


def evaluate(spark: SparkSession, findings: DataFrame, allow: Rules | None = None, deny: Rules | None = None, strict_host: bool = False, counted: DataFrame | None = None) -> DataFrame:
    """Rules and calibration over deduplicated findings. `counted`, the findings before dedup, spares a second dedup for the domain counts.

    Allowed rows go first, denied ones become critical with confidence 1, benign domains info with 0.2, and other links follow the
    rarity of their domain, counted before any row goes. The domain's flags and count are worked out once a domain, then joined
    back; the join is by hash of the domain, and AQE splits a domain that most files have.
    """
    allow, deny = allow or Rules(), deny or Rules()
    df = findings.withColumn("domain", evidence_domain(strict_host))
    domains = domain_flags(spark, domain_files(findings if counted is None else counted, strict_host), {"_allow_domain": allow.domains, "_deny_domain": deny.domains, "_benign": BENIGN_DOMAINS})
    df = df.join(domains.withColumnRenamed("domain", "_d"), F.col("domain") == F.col("_d"), "left").drop("_d")
    for flag, values, column in (("_allow_file", allow.files, "file"), ("_deny_file", deny.files, "file"), ("_allow_url", allow.urls, "evidence"), ("_deny_url", deny.urls, "evidence")):
        df = _flag(spark, df, values, column, flag)
    link = F.col("domain").isNotNull()
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    df = df.where(~yes("_allow_file") & ~(link & (yes("_allow_url") | yes("_allow_domain"))))
    pairs = [(k, v) for k, vs in allow.metadata.items() for v in vs]
    if pairs:
        values = spark.createDataFrame(pairs, "_sub string, _value string").groupBy("_sub").agg(F.collect_list("_value").alias("_values"))
        df = df.join(F.broadcast(values) if len(pairs) <= MOST_RULES else values, F.col("subcategory") == F.col("_sub"), "left")
        df = df.where(~(F.col("category").startswith("metadata_") & F.coalesce(F.exists("_values", lambda v: F.contains(F.col("evidence"), v)), F.lit(False)))).drop("_sub", "_values")
    denied = yes("_deny_file") | (link & (yes("_deny_url") | yes("_deny_domain")))
    sev, conf = calibrated(F.col("n_files"), F.col("confidence"))
    severity = F.when(denied, "critical").when(link & yes("_benign"), "info").when(link, F.coalesce(sev, "severity")).otherwise(F.col("severity"))
    confidence = F.when(denied, 1.0).when(link & yes("_benign"), 0.2).when(link, conf).otherwise(F.col("confidence"))
    return df.withColumn("_s", severity).withColumn("_c", confidence).select(*[F.col({"severity": "_s", "confidence": "_c"}.get(c, c)).alias(c) for c in findings.columns])


def threshold(findings: DataFrame, least: str = "info") -> DataFrame:
    return findings.where(rank(F.col("severity")) >= RANK[least])


def ordered(findings: DataFrame) -> DataFrame:
    """Most severe first (unknown last), then surest, then as made."""
    known = F.when(F.col("severity").isin(list(RANK)), rank(F.col("severity"))).otherwise(F.lit(-1))
    return findings.orderBy(known.desc(), F.col("confidence").desc(), "seq")


def report(spark: SparkSession, stages: list[DataFrame], allow: Rules | None = None, deny: Rules | None = None, least: str = "info", strict_host: bool = False) -> DataFrame:
    """Union, dedup, evaluate, threshold, order; the threshold sees calibrated severities."""
    made = union_all(stages)
    return ordered(threshold(evaluate(spark, dedup(made), allow, deny, strict_host, made), least))


def severity_summary(findings: DataFrame) -> DataFrame:
    """Counts by severity and category, most severe first, then by category."""
    return findings.groupBy("severity", "category").agg(F.count("*").alias("n")).orderBy(rank(F.col("severity")).desc(), "category")


def stage_summary(findings: DataFrame) -> DataFrame:
    """Total, critical and high findings by stage."""
    return findings.groupBy("stage").agg(F.count("*").alias("total"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"))


def rule_id() -> Column:
    return F.concat(F.lit("docsignal/"), F.col("category"), F.when(F.col("subcategory") != "", F.concat(F.lit("/"), F.col("subcategory"))).otherwise(F.lit("")))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(rule_id, category, finding, severity) of the first finding of each rule."""
    first = F.min_by(F.struct("category", "finding", "severity"), "seq")
    return findings.groupBy(rule_id().alias("rule_id")).agg(first.alias("f"), F.min("seq").alias("seq")).select("rule_id", "f.*", "seq")

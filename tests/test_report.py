from pyspark.sql import functions as F

from docsignal.operators import report
from docsignal.operators.report import Rules

SCHEMA = "file string, category string, subcategory string, evidence string, severity string, confidence double, seq long, stage string, finding string"


def rows(spark, data):
    full = [(*r, i, "remote-refs", "f") for i, r in enumerate(data)]
    return spark.createDataFrame(full, SCHEMA)


def get(df):
    return sorted((r.file, r.category, r.severity, round(r.confidence, 6)) for r in df.collect())


def test_dedup(spark):
    k = ("f", "c", "s", "e")
    df = rows(spark, [(*k, "medium", 0.7), ("z", "c", "s", "e", "low", 0.1), (*k, "critical", 0.9), (*k, "critical", 0.9), (*k, "low", 0.5)])
    out = report.dedup(df).orderBy("seq").collect()
    assert [(r.file, r.severity, r.confidence, r.seq) for r in out] == [("f", "critical", 0.9, 0), ("z", "low", 0.1, 1)]


def test_dedup_ties_take_the_first(spark):
    df = rows(spark, [("f", "c", "s", "e", "low", 0.5), ("f", "c", "s", "e", "low", 0.5)]).withColumn("finding", F.col("seq").cast("string"))
    assert [r.finding for r in report.dedup(df).collect()] == ["0"]


def test_rarity_boundaries(spark):
    data = [(f"f{n}_{i}", "active_url", "s", f"http://d{n}.test/p", "high", 0.8) for n in (1, 2, 5, 6, 20, 21) for i in range(n)]
    out = report.evaluate(spark, rows(spark, data)).collect()
    got = {r.evidence: (r.severity, round(r.confidence, 6)) for r in out}
    assert got == {"http://d1.test/p": ("critical", 0.9), "http://d2.test/p": ("high", 0.8), "http://d5.test/p": ("high", 0.8), "http://d6.test/p": ("medium", 0.7), "http://d20.test/p": ("medium", 0.7), "http://d21.test/p": ("low", 0.6)}


def test_bounds(spark):
    data = [("f", "active_url", "s", "http://one.test/", "low", 0.95)] + [(f"g{i}", "active_url", "s", "http://many.test/", "high", 0.4) for i in range(21)]
    got = {r.evidence: r.confidence for r in report.evaluate(spark, rows(spark, data)).collect()}
    assert got == {"http://one.test/": 1.0, "http://many.test/": 0.3}


def test_benign(spark):
    out = report.evaluate(spark, rows(spark, [("f", "active_url", "s", "http://www.w3.org/1999/xhtml", "critical", 0.9), ("f", "javascript", "s", "http://w3.org", "high", 0.9)]))
    assert get(out) == [("f", "active_url", "info", 0.2), ("f", "javascript", "high", 0.9)]


def test_allow(spark):
    data = [("f0", "active_url", "s", "http://a.ok.test/x", "high", 0.8), ("f1", "active_url", "s", "http://url.test/1", "high", 0.8), ("f2", "javascript", "s", "x", "high", 0.8), ("f3", "metadata_pii", "author", "by Known Person", "high", 0.8), ("f4", "metadata_pii", "title", "by Known Person", "high", 0.8), ("f5", "active_url", "s", "http://star.test/", "high", 0.8)]
    rules = Rules(domains=["ok.test", "*.star.test"], urls=["http://url.test/1"], files=["f2"], metadata={"author": ["nobody", "Known"]})
    assert [r.file for r in report.evaluate(spark, rows(spark, data), rules).collect()] == ["f4"]


def test_deny_and_precedence(spark):
    data = [("f0", "active_url", "s", "http://bad.test/x", "low", 0.3), ("f1", "active_url", "s", "http://github.com/x", "low", 0.3), ("f2", "javascript", "s", "x", "low", 0.3), ("f3", "active_url", "s", "http://both.test/x", "low", 0.3)]
    deny = Rules(domains=["bad.test", "both.test"], urls=["http://github.com/x"], files=["f2"])
    out = report.evaluate(spark, rows(spark, data), Rules(domains=["both.test"]), deny)
    assert get(out) == [("f0", "active_url", "critical", 1.0), ("f1", "active_url", "critical", 1.0), ("f2", "javascript", "critical", 1.0)]


def test_order_threshold_and_summary(spark):
    df = rows(spark, [("a", "x", "s", "1", "low", 0.9), ("b", "x", "s", "2", "critical", 0.1), ("c", "y", "s", "3", "critical", 0.1), ("d", "x", "s", "4", "odd", 0.9), ("e", "x", "s", "5", "critical", 0.5)])
    assert [r.file for r in report.ordered(df).collect()] == ["e", "b", "c", "a", "d"]
    assert sorted(r.file for r in report.threshold(df, "low").collect()) == ["a", "b", "c", "e"]
    assert [tuple(r) for r in report.severity_summary(df).collect()][:2] == [("critical", "x", 2), ("critical", "y", 1)]
    assert tuple(report.stage_summary(df).first()) == ("remote-refs", 5, 3, 0)


def test_empty(spark):
    assert report.report(spark, [rows(spark, [])]).count() == 0


def test_rules_by_shuffle_agree(spark, monkeypatch):
    monkeypatch.setattr(report, "MOST_RULES", 0)
    test_allow(spark)
    test_deny_and_precedence(spark)

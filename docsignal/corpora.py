"""Inputs of the queries, derived from the driver's tables by deterministic expressions that DuckDB can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col
EXTS = [".pdf", ".rtf", ".docx", ".odt", ".doc", ".html", ".eml", ".png", ".csv", ".xml", ".zip", ".mp3", ".xyz"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cat(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def pages_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML files (path, raw, url, bucket): pages with one link each, in a form given by page_id mod 8."""
    k, u = C("page_id") % 8, C("url")
    host = F.regexp_extract(u, "^https?://([^/?#]*)", 1)
    tail = F.when(k == 0, cat('<img src="', u, '" width="1">')).when(k == 1, cat('<img src="', u, '">')).when(k == 2, cat('<script src="', u, '"></script>')).when(k == 3, cat('<iframe src="', u, '">')).when(k == 4, cat('<a href="', u, '" ping="/p">')).when(k == 5, cat("ftp://", host, "/f")).when(k == 6, cat("\\\\", host, "\\s")).otherwise("")
    return table(spark, sf_dir, "pages").select(cat("pages/", C("page_id").cast("string"), ".html").alias("path"), F.concat("html", tail).alias("raw"), "url", F.lit("html").alias("bucket"), F.lit(".html").alias("extension"), F.lit("").alias("sha256"))


HTML_SQL = r"""pages_html AS (SELECT 'pages/' || page_id || '.html' AS path, url, html || CASE page_id % 8
 WHEN 0 THEN '<img src="' || url || '" width="1">' WHEN 1 THEN '<img src="' || url || '">' WHEN 2 THEN '<script src="' || url || '"></script>'
 WHEN 3 THEN '<iframe src="' || url || '">' WHEN 4 THEN '<a href="' || url || '" ping="/p">' WHEN 5 THEN 'ftp://' || regexp_extract(url, '^https?://([^/?#]*)', 1) || '/f'
 WHEN 6 THEN '\\' || regexp_extract(url, '^https?://([^/?#]*)', 1) || '\s' ELSE '' END AS raw FROM pages)"""


def event_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings made of events: domain k has 2k + 1 rows, each tenth is a benign host, one event type carries no link."""
    e = table(spark, sf_dir, "events")
    k = F.floor(F.sqrt(C("event_id").cast("double"))).cast("long")
    n = F.when(C("event_type") == "click", 0).when(C("event_type") == "error", 1).when(C("event_type") == "purchase", 2).when(C("event_type") == "signup", 3).otherwise(4)
    host = F.when(k % 10 == 3, "www.w3.org").otherwise(cat("h", k.cast("string"), ".example.com"))
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (n + 1).cast("int"))
    return e.select(
        cat("u", C("user_id").cast("string"), ".pdf").alias("file"),
        F.lit("").alias("sha256"),
        F.lit(".pdf").alias("file_type"),
        F.lit("pdf").alias("bucket"),
        pick("metadata", "remote-refs", "remote-refs", "embedded", "uniqueness").alias("stage"),
        pick("metadata_pii", "active_url", "tracking_pixel", "active_url", "active_url").alias("category"),
        pick("author", "uri_action", "img_beacon", "pdf_raw_url", "hyperlink").alias("subcategory"),
        C("event_type").alias("finding"),
        cat("http://", host, "/p").alias("evidence"),
        F.lit("t").alias("tool"),
        pick("low", "high", "critical", "medium", "info").alias("severity"),
        F.element_at(F.array(*map(F.lit, (0.3, 0.5, 0.7, 0.8, 0.9))), (C("event_id") % 5 + 1).cast("int")).alias("confidence"),
        F.create_map().cast("map<string,string>").alias("extras"),
        C("event_id").alias("seq"),
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File records made of documents, with an extension by doc_id mod 13."""
    ext = F.element_at(F.array(*map(F.lit, EXTS)), (C("doc_id") % len(EXTS) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(cat("d/", C("doc_id").cast("string"), ext).alias("path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"), C("text").cast("binary").alias("content"), "doc_id", "lang", "source", "text")

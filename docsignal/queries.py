"""Queries of the screening engine over derived inputs, each with the SQL that gives the same rows."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpora import HTML_SQL, cat, event_findings, inventory, pages_html, table
from .functions import text as fx
from .operators import detect, metadata, report, uniqueness
from .operators.report import Rules
from .sources import containers, files
from .sources.batches import BATCH, bounded, rows_of
from .vocab import BENIGN_DOMAINS

C = F.col
COLS = ["file", "category", "subcategory", "evidence", "severity", "confidence"]
ALLOW = Rules(domains=["h7.example.com", "*.h8.example.com"], urls=["http://h9.example.com/p"], files=["u1.pdf", "u2.pdf"], metadata={"author": ["h11."]})
DENY = Rules(domains=["h12.example.com"], urls=["http://h13.example.com/p"], files=["u3.pdf"])


def _q(*values: str) -> str:
    return ", ".join("'" + v + "'" for v in values)


# ---- SQL of the shared inputs -------------------------------------------------------------------------------------------

EVENTS_SQL = """ev AS (SELECT event_id, user_id, event_type, CAST(floor(sqrt(CAST(event_id AS DOUBLE))) AS BIGINT) AS k, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS n FROM events),
f AS (SELECT 'u' || user_id || '.pdf' AS file,
 CASE n WHEN 0 THEN 'metadata' WHEN 1 THEN 'remote-refs' WHEN 2 THEN 'remote-refs' WHEN 3 THEN 'embedded' ELSE 'uniqueness' END AS stage,
 CASE n WHEN 0 THEN 'metadata_pii' WHEN 2 THEN 'tracking_pixel' ELSE 'active_url' END AS category,
 CASE n WHEN 0 THEN 'author' WHEN 1 THEN 'uri_action' WHEN 2 THEN 'img_beacon' WHEN 3 THEN 'pdf_raw_url' ELSE 'hyperlink' END AS subcategory,
 event_type AS finding, 'http://' || CASE WHEN k % 10 = 3 THEN 'www.w3.org' ELSE 'h' || k || '.example.com' END || '/p' AS evidence,
 CASE n WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 2 THEN 'critical' WHEN 3 THEN 'medium' ELSE 'info' END AS severity,
 CASE event_id % 5 WHEN 0 THEN 0.3::DOUBLE WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0.7::DOUBLE WHEN 3 THEN 0.8::DOUBLE ELSE 0.9::DOUBLE END AS confidence,
 event_id AS seq FROM ev)"""
RANK_SQL = "CASE {} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
DEDUP_SQL = f"""{EVENTS_SQL},
d AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY file, category, subcategory, evidence ORDER BY {RANK_SQL.format("severity")} DESC, confidence DESC, seq) AS rn,
 min(seq) OVER (PARTITION BY file, category, subcategory, evidence) AS first_seq FROM f) WHERE rn = 1)"""
LINK_SQL = "category IN ('active_url', 'tracking_pixel')"
DOMAIN_SQL = "regexp_extract(evidence, '^https?://([^/?#:]*)', 1)"
PREV_SQL = f"""{DEDUP_SQL},
p AS (SELECT {DOMAIN_SQL} AS domain, count(DISTINCT file) AS n_files FROM d WHERE {LINK_SQL} GROUP BY 1)"""
BENIGN_SQL = " OR ".join(f"domain = '{b}' OR domain LIKE '%.{b}'" for b in BENIGN_DOMAINS)


def _calibrated_sql(denied: str = "FALSE") -> str:
    return f"""j AS (SELECT d.*, p.domain, p.n_files, {LINK_SQL} AS link, ({denied}) AS denied, coalesce({BENIGN_SQL}, FALSE) AS benign FROM d LEFT JOIN p ON {LINK_SQL} AND {DOMAIN_SQL} = p.domain),
c AS (SELECT file, stage, category, subcategory, finding, evidence, first_seq,
 CASE WHEN denied THEN 'critical' WHEN NOT link THEN severity WHEN benign THEN 'info' WHEN n_files = 1 THEN 'critical' WHEN n_files > 20 THEN 'low' WHEN n_files > 5 THEN 'medium' ELSE severity END AS severity,
 CASE WHEN denied THEN 1.0::DOUBLE WHEN NOT link THEN confidence WHEN benign THEN 0.2::DOUBLE WHEN n_files = 1 THEN least(1.0::DOUBLE, confidence + 0.1::DOUBLE) WHEN n_files > 20 THEN greatest(0.3::DOUBLE, confidence + -0.2::DOUBLE) WHEN n_files > 5 THEN greatest(0.5::DOUBLE, confidence + -0.1::DOUBLE) ELSE confidence END AS confidence FROM j)"""


INV_SQL = """inv AS (SELECT doc_id, lang, source, text, 'd/' || doc_id || CASE doc_id % 13 WHEN 0 THEN '.pdf' WHEN 1 THEN '.rtf' WHEN 2 THEN '.docx' WHEN 3 THEN '.odt' WHEN 4 THEN '.doc' WHEN 5 THEN '.html' WHEN 6 THEN '.eml' WHEN 7 THEN '.png' WHEN 8 THEN '.csv' WHEN 9 THEN '.xml' WHEN 10 THEN '.zip' WHEN 11 THEN '.mp3' ELSE '.xyz' END AS path FROM documents)"""
BUCKET_SQL = "CASE regexp_extract(path, '(\\.[a-z0-9]+)$', 1) WHEN '.pdf' THEN 'pdf' WHEN '.rtf' THEN 'rtf' WHEN '.docx' THEN 'ooxml' WHEN '.odt' THEN 'odf' WHEN '.doc' THEN 'ole' WHEN '.html' THEN 'html' WHEN '.eml' THEN 'email' WHEN '.png' THEN 'image' WHEN '.csv' THEN 'csv' WHEN '.xml' THEN 'xml' WHEN '.zip' THEN 'archive' ELSE 'other' END"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


# ---- sources and classification ------------------------------------------------------------------------------------------


@query("inventory_classify", f"WITH {INV_SQL} SELECT path, regexp_extract(path, '(\\.[a-z0-9]+)$', 1) AS extension, {BUCKET_SQL} AS bucket, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM inv")
def inventory_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.classify(inventory(spark, sf_dir)).select("path", "extension", "bucket", "sha256", "size")


@query("specialized_kind", f"WITH {INV_SQL} SELECT path, CASE WHEN path LIKE '%.mp3' THEN 'specialized' ELSE {BUCKET_SQL} END AS bucket, CASE WHEN path LIKE '%.mp3' THEN 'audio' ELSE 'unknown' END AS kind FROM inv")
def specialized_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.classify(inventory(spark, sf_dir), specialized=True).select("path", "bucket", files.specialized_kind(C("extension")).alias("kind"))


# ---- text functions and detectors -----------------------------------------------------------------------------------------


@query("url_extract", f"WITH {HTML_SQL} SELECT path, unnest(regexp_extract_all(raw, '(?i)https?://[^\\s\"''<>]+')) AS url FROM pages_html")
def url_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_html(spark, sf_dir).select("path", F.explode(fx.urls(C("raw"))).alias("url"))


@query("ftp_extract", f"WITH {HTML_SQL} SELECT path, unnest(regexp_extract_all(raw, '(?i)ftp://[^\\s\"''<>]+')) AS ftp FROM pages_html")
def ftp_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_html(spark, sf_dir).select("path", F.explode(fx.ftps(C("raw"))).alias("ftp"))


@query("unc_extract", f"WITH {HTML_SQL} SELECT path, unnest(regexp_extract_all(raw, '\\\\\\\\[\\w.-]+\\\\[\\w.-]+')) AS unc FROM pages_html")
def unc_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_html(spark, sf_dir).select("path", F.explode(fx.uncs(C("raw"))).alias("unc"))


@query("ip_extract", "SELECT doc_id, unnest(regexp_extract_all(text, '\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b')) AS ip FROM documents")
def ip_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(fx.ips(C("text"))).alias("ip"))


@query("clean_url", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN url || '/about/' WHEN 1 THEN url ELSE url || CASE WHEN url LIKE '%/' THEN '' ELSE '/' END END AS cleaned, page_id % 3 <> 1 AS token FROM pages")
def clean_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = C("page_id") % 3
    u = F.when(k == 0, cat("(", C("url"), "/about/QXUGUTAENT)")).when(k == 1, cat("<'", C("url"), "'>")).otherwise(cat(C("url"), "/QXUGUTAENT/feedback"))
    # the opening parenthesis is not a mark that is stripped before a link, so it is taken off here
    u = F.regexp_replace(u, r"^\(", "")
    u = F.when(k == 1, F.regexp_replace(u, "^<", "")).otherwise(u)
    return table(spark, sf_dir, "pages").select("page_id", fx.clean_url(u).alias("cleaned"), fx.has_token(u).alias("token"))


@query("domain_of", f"WITH {HTML_SQL} SELECT path, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS domain, CAST(len(string_split(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '.')) AS BIGINT) AS n_suffixes FROM pages_html")
def domain_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.domain(C("url"))
    return pages_html(spark, sf_dir).select("path", d.alias("domain"), F.size(fx.suffixes(d)).cast("long").alias("n_suffixes"))


_TAG = "lower(regexp_extract(split_part(raw, u, 1), '<([^<>\\s]*)[^<]*$', 1))"


def _html_sql(pages: str) -> str:
    """Hits of the HTML files in a table (path, raw)."""
    return f"""SELECT path AS file, CASE WHEN tag = 'img' AND pixel THEN 'tracking_pixel' WHEN tag = 'script' THEN 'javascript' ELSE 'active_url' END AS category, CASE WHEN tag = 'img' AND pixel THEN 'img_beacon' WHEN tag = 'img' THEN 'img' WHEN tag = 'script' THEN 'script_src' WHEN tag = 'iframe' THEN 'iframe' WHEN tag = '' THEN 'link' ELSE tag END AS subcategory, u AS evidence,
 CASE WHEN tag = 'img' AND pixel OR tag IN ('script', 'iframe') THEN 'critical' WHEN tag = 'img' THEN 'high' ELSE 'medium' END AS severity, CASE WHEN tag = 'img' AND pixel OR tag IN ('script', 'iframe') THEN 0.9::DOUBLE WHEN tag = 'img' THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END AS confidence
 FROM (SELECT path, u, {_TAG} AS tag, contains(raw, '<img src="' || u || '" width="1"') AS pixel FROM (SELECT path, raw, unnest(regexp_extract_all(raw, '(?i)https?://[^\\s"''<>]+')) AS u FROM {pages}))
UNION ALL SELECT path, 'active_url', 'ftp', unnest(regexp_extract_all(raw, '(?i)ftp://[^\\s"''<>]+')), 'high', 0.7::DOUBLE FROM {pages}
UNION ALL SELECT path, 'active_url', 'unc_path', unnest(regexp_extract_all(raw, '\\\\\\\\[\\w.-]+\\\\[\\w.-]+')), 'critical', 0.9::DOUBLE FROM {pages}
UNION ALL SELECT path, 'tracking_pixel', 'ping', 'ping=', 'high', 0.7::DOUBLE FROM {pages} WHERE contains(lower(raw), 'ping=')"""


@query("html_detect", f"WITH {HTML_SQL} {_html_sql('pages_html')}")
def html_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .schema import findings

    return findings(pages_html(spark, sf_dir), "remote-refs", 2, detect.html_hits(C("raw"))).select(*COLS)


def _hits(df: DataFrame, key: str, hits) -> DataFrame:
    return df.select(C(key).alias("file"), F.explode(hits).alias("h")).select("file", "h.category", "h.subcategory", "h.evidence", "h.severity", "h.confidence")


_SCAN = """SELECT file, 'active_url' AS category, '{sub}' AS subcategory, unnest(regexp_extract_all(x, '(?i)https?://[^\\s"''<>]+')) AS evidence, '{sev}' AS severity, {conf}::DOUBLE AS confidence FROM {t}"""


@query("raw_text_scan", f"WITH {HTML_SQL}, t AS (SELECT path AS file, raw AS x FROM pages_html) " + _SCAN.format(sub="hyperlink", sev="critical", conf=0.8, t="t") + """ UNION ALL SELECT file, 'active_url', 'hyperlink_ftp', unnest(regexp_extract_all(x, '(?i)ftp://[^\\s"''<>]+')), 'critical', 0.8::DOUBLE FROM t UNION ALL SELECT file, 'active_url', 'unc_path', unnest(regexp_extract_all(x, '\\\\\\\\[\\w.-]+\\\\[\\w.-]+')), 'critical', 0.9::DOUBLE FROM t""")
def raw_text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(pages_html(spark, sf_dir), "path", fx.scan_text(C("raw"), C("bucket"), "rg", "hyperlink", "critical", 0.8))


@query(
    "csv_formula",
    """WITH t AS (SELECT CAST(page_id AS VARCHAR) AS file, CASE page_id % 4 WHEN 0 THEN '=HYPERLINK("' || url || '")' WHEN 1 THEN '+cmd|' || url WHEN 2 THEN '=SUM(1)' ELSE url END AS x FROM pages), r AS (SELECT * FROM t WHERE regexp_matches(x, '^[=+@-]') AND (regexp_matches(x, '(?i)^=(HYPERLINK|WEBSERVICE|IMPORTDATA|IMPORTXML|IMAGE)\\b') OR contains(x, 'cmd|')))
SELECT file, 'formula_injection' AS category, 'csv_formula' AS subcategory, substr(x, 1, 200) AS evidence, 'medium' AS severity, 0.8::DOUBLE AS confidence FROM r UNION ALL """
    + """SELECT file, 'active_url', 'csv_formula_url', trim(u, ')'), 'critical', 0.9::DOUBLE FROM (SELECT file, unnest(regexp_extract_all(x, '(?i)https?://[^\\s"''<>]+')) AS u FROM r)""",
)
def csv_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u = C("page_id") % 4, C("url")
    cell = F.when(k == 0, cat('=HYPERLINK("', u, '")')).when(k == 1, cat("+cmd|", u)).when(k == 2, "=SUM(1)").otherwise(u)
    return _hits(table(spark, sf_dir, "pages").select(C("page_id").cast("string").alias("f"), cell.alias("cell")), "f", detect.csv_hits(C("cell"), F.lit("csv")))


@query("xml_external", """SELECT CAST(page_id AS VARCHAR) AS file, 'external_entity' AS category, 'xxe' AS subcategory, url AS evidence, 'critical' AS severity, 0.8::DOUBLE AS confidence FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT CAST(page_id AS VARCHAR), 'external_entity', 'xslt_document', url, 'high', 0.7::DOUBLE FROM pages WHERE page_id % 3 = 1""")
def xml_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u = C("page_id") % 3, C("url")
    x = F.when(k == 0, cat('<!DOCTYPE r [<!ENTITY x SYSTEM "', u, '">]><r/>')).when(k == 1, cat("<r select=\"document('", u, "')\"/>")).otherwise(cat("<r>", u, "</r>"))
    return _hits(table(spark, sf_dir, "pages").select(C("page_id").cast("string").alias("f"), x.alias("x"), (k != 0).alias("ok")), "f", detect.xml_hits(C("x"), C("ok")))


@query("rtf_objects", """WITH t AS (SELECT CAST(page_id AS VARCHAR) AS file, page_id % 3 AS k, url FROM pages) SELECT file, 'active_url' AS category, 'hyperlink' AS subcategory, url AS evidence, 'critical' AS severity, 0.8::DOUBLE AS confidence FROM t UNION ALL SELECT file, 'embedded_object', 'objhtml', '\\objhtml/\\objupdate', 'critical', 0.9::DOUBLE FROM t WHERE k = 0 UNION ALL SELECT file, 'embedded_object', 'objdata', '\\objdata', 'high', 0.7::DOUBLE FROM t WHERE k = 1""")
def rtf_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = C("page_id") % 3
    x = cat("{\\rtf1 ", F.when(k == 0, "\\objupdate ").when(k == 1, "{\\*\\objdata 01} ").otherwise(""), C("url"), " }")
    return _hits(table(spark, sf_dir, "pages").select(C("page_id").cast("string").alias("f"), x.alias("x")), "f", detect.rtf_hits(C("x"), F.lit("rtf")))


@query(
    "ooxml_members",
    """WITH t AS (SELECT CAST(page_id AS VARCHAR) AS file, page_id % 6 AS k, url FROM pages)
SELECT file, 'active_url' AS category, CASE k WHEN 0 THEN 'external_rel' WHEN 1 THEN 'header1.xml' WHEN 2 THEN 'customxml' WHEN 3 THEN 'zip_member_theme1.xml' WHEN 4 THEN 'zip_member_oleObject1.bin' ELSE 'document.xml' END AS subcategory, url AS evidence, CASE k WHEN 0 THEN 'critical' WHEN 2 THEN 'medium' ELSE 'high' END AS severity, CASE k WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.8::DOUBLE WHEN 2 THEN 0.6::DOUBLE WHEN 5 THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM t
UNION ALL SELECT file, 'embedded_object', 'oleObject1.bin', 'word/embeddings/oleObject1.bin', 'high', 0.7::DOUBLE FROM t WHERE k = 4
UNION ALL SELECT file, 'javascript', 'dde_link', 'DDEAUTO ' || url, 'critical', 0.9::DOUBLE FROM t WHERE k = 5""",
)
def ooxml_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u = C("page_id") % 6, C("url")
    name = F.when(k == 0, "word/_rels/document.xml.rels").when(k == 1, "word/header1.xml").when(k == 2, "customXml/item1.xml").when(k == 3, "word/theme/theme1.xml").when(k == 4, "word/embeddings/oleObject1.bin").otherwise("word/document.xml")
    data = F.when(k == 0, cat('TargetMode="External" ', u)).when(k == 5, cat("DDEAUTO ", u)).otherwise(u)
    return _hits(table(spark, sf_dir, "pages").select(C("page_id").cast("string").alias("f"), name.alias("name"), data.alias("data")), "f", detect.ooxml_hits(C("name"), C("data"), F.lit("ooxml")))


@query(
    "email_headers",
    """WITH t AS (SELECT CAST(page_id AS VARCHAR) AS file, page_id % 4 AS k, url FROM pages)
SELECT file, 'suspicious_metadata_field' AS category, CASE k WHEN 0 THEN 'email_header/x_mailer' ELSE 'email_header/received' END AS subcategory, url AS evidence, 'info' AS severity, 0.5::DOUBLE AS confidence FROM t WHERE k < 2
UNION ALL SELECT file, 'read_receipt', 'disposition_notification', url, 'medium', 0.7::DOUBLE FROM t WHERE k = 2""",
)
def email_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = C("page_id") % 4
    name = F.when(k == 0, "X-Mailer").when(k == 1, "Received").when(k == 2, "Disposition-Notification-To").otherwise("Subject")
    t = table(spark, sf_dir, "pages").select(C("page_id").cast("string").alias("f"), name.alias("name"), "url")
    return _hits(t, "f", F.concat(detect.header_hits(C("name"), C("url"), F.lit("email")), detect.receipt_hits(C("name"), C("url"))))


@query(
    "email_html",
    f"""WITH {HTML_SQL}, l AS (SELECT path, raw, unnest(regexp_extract_all(raw, '(?i)https?://[^\\s"''<>]+')) AS u FROM pages_html)
SELECT path AS file, CASE WHEN contains(raw, '<img src="' || u || '" width="1"') THEN 'tracking_pixel' ELSE 'active_url' END AS category, CASE WHEN contains(raw, '<img src="' || u || '" width="1"') THEN 'eml_beacon' ELSE 'eml_img' END AS subcategory, u AS evidence, CASE WHEN contains(raw, '<img src="' || u || '" width="1"') THEN 'critical' ELSE 'high' END AS severity, CASE WHEN contains(raw, '<img src="' || u || '" width="1"') THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM l
UNION ALL SELECT path, 'active_url', 'eml_ftp', unnest(regexp_extract_all(raw, '(?i)ftp://[^\\s"''<>]+')), 'high', 0.7::DOUBLE FROM pages_html
UNION ALL SELECT path, 'active_url', 'unc_path', unnest(regexp_extract_all(raw, '\\\\\\\\[\\w.-]+\\\\[\\w.-]+')), 'critical', 0.9::DOUBLE FROM pages_html""",
)
def email_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(pages_html(spark, sf_dir), "path", detect.mail_html_hits(C("raw")))


_TAGS_SQL = """WITH t AS (SELECT 'c' || c_custkey AS file, 'Author' AS k, c_name AS v FROM customer UNION ALL SELECT 'c' || c_custkey, 'XMP:DocumentID', CAST(c_nationkey AS VARCHAR) FROM customer UNION ALL SELECT 'c' || c_custkey, 'Producer', 'https://' || c_mktsegment || '.example.com/' FROM customer UNION ALL SELECT 'c' || c_custkey, 'Other', c_mktsegment FROM customer)"""


@query(
    "metadata_flags",
    f"""{_TAGS_SQL} SELECT file, 'metadata_pii' AS category, 'author' AS subcategory, v AS evidence, 'medium' AS severity, 0.6::DOUBLE AS confidence FROM t WHERE k = 'Author' UNION ALL SELECT file, 'metadata_unique', 'documentid', v, 'medium', 0.7::DOUBLE FROM t WHERE k = 'XMP:DocumentID' UNION ALL SELECT file, 'active_url', 'producer', v, 'high', 0.7::DOUBLE FROM t WHERE k = 'Producer'""",
)
def metadata_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.create_map(F.lit("Author"), C("c_name"), F.lit("XMP:DocumentID"), C("c_nationkey").cast("string"), F.lit("Producer"), cat("https://", C("c_mktsegment"), ".example.com/"), F.lit("Other"), C("c_mktsegment"))
    t = table(spark, sf_dir, "customer").select(cat("c", C("c_custkey").cast("string")).alias("f"), F.explode(tags).alias("k", "v"))
    return _hits(t, "f", metadata.tag_hits(C("k"), C("v")))


# ---- report ----------------------------------------------------------------------------------------------------------------


@query("findings_dedup", f"WITH {DEDUP_SQL} SELECT file, category, subcategory, evidence, severity, confidence, finding, first_seq AS seq FROM d")
def findings_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.dedup(event_findings(spark, sf_dir)).select(*COLS, "finding", "seq")


@query("domain_prevalence", f"WITH {PREV_SQL} SELECT domain, n_files FROM p")
def domain_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.domain_files(event_findings(spark, sf_dir))


@query("calibrate", f"WITH {PREV_SQL}, {_calibrated_sql()} SELECT file, category, subcategory, evidence, severity, confidence FROM c")
def calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_findings(spark, sf_dir)
    return report.evaluate(spark, report.dedup(e), counted=e).select(*COLS)


_ALLOWED = f"""file IN ({_q(*ALLOW.files)}) OR ({LINK_SQL} AND (evidence IN ({_q(*ALLOW.urls)}) OR {DOMAIN_SQL} = 'h7.example.com' OR {DOMAIN_SQL} LIKE '%.h7.example.com' OR {DOMAIN_SQL} = 'h8.example.com' OR {DOMAIN_SQL} LIKE '%.h8.example.com')) OR (category LIKE 'metadata\\_%' ESCAPE '\\' AND subcategory = 'author' AND contains(evidence, 'h11.'))"""
_DENIED = f"""file IN ({_q(*DENY.files)}) OR ({LINK_SQL} AND (evidence IN ({_q(*DENY.urls)}) OR {DOMAIN_SQL} = 'h12.example.com'))"""


@query("allow_deny", f"WITH {PREV_SQL}, {_calibrated_sql(_DENIED)} SELECT file, category, subcategory, evidence, severity, confidence FROM c WHERE NOT ({_ALLOWED})")
def allow_deny(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_findings(spark, sf_dir)
    return report.evaluate(spark, report.dedup(e), ALLOW, DENY, counted=e).select(*COLS)


@query("severity_threshold", f"WITH {PREV_SQL}, {_calibrated_sql()} SELECT file, category, subcategory, evidence, severity, confidence FROM c WHERE {RANK_SQL.format('severity')} >= 2")
def severity_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report(spark, [event_findings(spark, sf_dir)], least="medium").select(*COLS)


@query("report_topk", f"WITH {PREV_SQL}, {_calibrated_sql()} SELECT file, category, subcategory, evidence, severity, confidence FROM c ORDER BY {RANK_SQL.format('severity')} DESC, confidence DESC, first_seq LIMIT 100")
def report_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report(spark, [event_findings(spark, sf_dir)]).limit(100).select(*COLS)


@query("severity_summary", f"WITH {PREV_SQL}, {_calibrated_sql()} SELECT severity, category, count(*) AS n FROM c GROUP BY ALL")
def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_findings(spark, sf_dir)
    return report.severity_summary(report.evaluate(spark, report.dedup(e), counted=e))


@query("stage_summary", f"WITH {EVENTS_SQL} SELECT stage, count(*) AS total, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high FROM f GROUP BY stage")
def stage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.stage_summary(event_findings(spark, sf_dir))


@query("sarif_rules", f"WITH {EVENTS_SQL} SELECT 'docsignal/' || category || '/' || subcategory AS rule_id, arg_min(category, seq) AS category, arg_min(finding, seq) AS finding, arg_min(severity, seq) AS severity, min(seq) AS seq FROM f GROUP BY 1")
def sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sarif_rules(event_findings(spark, sf_dir))


@query("union_stages", f"WITH {EVENTS_SQL} SELECT stage, category, count(*) AS n FROM f GROUP BY ALL")
def union_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_findings(spark, sf_dir)
    return report.union_all([e.where(C("stage") == s) for s in ("metadata", "remote-refs", "embedded", "uniqueness")]).groupBy("stage", "category").agg(F.count("*").alias("n"))


# ---- uniqueness --------------------------------------------------------------------------------------------------------------


def _members(spark: SparkSession, sf_dir: str, fuzzy: bool = False) -> DataFrame:
    inv = files.classify(inventory(spark, sf_dir))
    tags = F.create_map(F.lit("Producer"), cat(C("lang"), " v", (C("doc_id") % 3 + 1).cast("string"), ".0"), F.lit("Creator"), C("source"), F.lit("DocumentID"), (C("doc_id") % 5).cast("string"))
    meta = inventory(spark, sf_dir).select("path", tags.alias("tags"), F.array().cast("array<struct<obj:string,ft:string,t:string,tu:string,v:string>>").alias("form_fields"))
    return uniqueness.clusters(inv, meta, fuzzy)


_CLUSTER_SQL = f"""WITH {INV_SQL}, k AS (SELECT *, {BUCKET_SQL} AS bucket, lang || '{{v}}' AS prod FROM inv), m AS (SELECT *, bucket || '|prod=' || prod || '|creat=' || {{src}} AS cluster_id FROM k), s AS (SELECT cluster_id, count(*) AS cluster_size FROM m GROUP BY 1 HAVING count(*) >= 2)"""
_EXACT, _FUZZY = _CLUSTER_SQL.format(v="", src="source").replace("lang || ''", "lang || ' v' || (doc_id % 3 + 1) || '.0'"), _CLUSTER_SQL.format(v="", src="regexp_replace(source, 'v?\\d[\\d.]+', '', 'g')").replace("lang || ''", "lang")


@query("cluster_build", f"{_EXACT} SELECT path, cluster_id, cluster_size FROM m JOIN s USING (cluster_id)")
def cluster_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir).select("path", "cluster_id", "cluster_size")


@query("cluster_fuzzy", f"{_FUZZY} SELECT path, cluster_id, cluster_size FROM m JOIN s USING (cluster_id)")
def cluster_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir, True).select("path", "cluster_id", "cluster_size")


@query("cluster_text_diff", """WITH v AS (SELECT doc_id, text AS t FROM documents UNION ALL SELECT doc_id, replace(text, chr(10), ' ' || chr(13) || chr(10)) || CASE doc_id % 3 WHEN 0 THEN '!' ELSE '  ' END FROM documents), c AS (SELECT doc_id, sha256(t) AS h, sha256(trim(regexp_replace(replace(t, chr(13) || chr(10), chr(10)), '[ \\t]+(\\n|$)', '\\1', 'g'), ' ' || chr(10) || chr(9))) AS n FROM v) SELECT CAST(doc_id AS VARCHAR) AS cluster_id, CASE WHEN count(DISTINCT n) = 1 THEN 'canonicalization_diff' ELSE 'raw_text_bytes' END AS field FROM c GROUP BY doc_id HAVING count(DISTINCT h) > 1""")
def cluster_text_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(C("doc_id").cast("string").alias("cluster_id"), "text", "doc_id")
    other = d.select("cluster_id", F.concat(F.replace("text", F.lit("\n"), F.lit(" \r\n")), F.when(C("doc_id") % 3 == 0, "!").otherwise("  ")).alias("text"))
    return uniqueness.text_diffs(d.select("cluster_id", "text").unionByName(other), C("text")).select("cluster_id", "field")


@query("cluster_field_diff", "SELECT CAST(c_nationkey AS VARCHAR) AS cluster_id, 'documentid' AS field, string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS evidence FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1")
def cluster_field_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "customer").select(C("c_nationkey").cast("string").alias("cluster_id"), F.create_map(F.lit("DocumentID"), C("c_mktsegment")).alias("tags"))
    return uniqueness.tag_diffs(m).select("cluster_id", "field", "evidence")


@query("form_field_diff", "WITH g AS (SELECT CAST(c_nationkey AS VARCHAR) AS cluster_id, count(DISTINCT c_mktsegment) AS k, count(DISTINCT c_name) AS n FROM customer GROUP BY 1 HAVING count(*) > 1) SELECT cluster_id, 'pdf_form_field' AS field FROM g WHERE k > 1 OR n > 1")
def form_field_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    field = F.struct(F.lit("1 0").alias("obj"), F.lit("/Tx").alias("ft"), F.lit("name").alias("t"), C("c_mktsegment").alias("tu"), C("c_name").alias("v"))
    m = c.select(C("c_nationkey").cast("string").alias("cluster_id"), C("c_name").alias("path"), F.array(field).alias("form_fields"))
    sizes = m.groupBy("cluster_id").agg(F.count("*").alias("cluster_size")).where("cluster_size > 1")
    return uniqueness.field_diffs(m.join(sizes, "cluster_id")).select("cluster_id", "field")


# ---- containers: files are made of the pages, so SQL can say what must be found in them --------------------------------------------


def _as_files(spark: SparkSession, sf_dir: str, make, ext: str, bucket: str) -> DataFrame:
    """Files built from all pages by a function (page_id, url, html) -> bytes."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for i, url, html in rows_of(batch):
                rows.append((f"p/{i}{ext}", make(i, url, html)))
                size += len(rows[-1][1]) + 200
                if size >= BATCH:
                    yield batch_of(rows)
                    rows, size = [], 0
            yield batch_of(rows)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.binary()))], names=["path", "content"])

    df = bounded(table(spark, sf_dir, "pages").select("page_id", "url", "html")).mapInArrow(run, "path string, content binary")
    df = df.select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"), F.lit(None).cast("timestamp").alias("mtime"), "content")
    return files.classify(df).withColumn("bucket", F.lit(bucket))


def make_zip(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in members.items():
            z.writestr(k, v)
    return out.getvalue()


def make_pdf(url: str) -> bytes:
    stream = zlib.compress(f"see {url}".encode())
    return b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /OpenAction << /S /URI /URI (" + url.encode() + b") >> >>\nendobj\n2 0 obj\n<< /Length " + str(len(stream)).encode() + b" >>\nstream\n" + stream + b"\nendstream\nendobj\ntrailer\n<< /Root 1 0 R >>\n%%EOF\n"


def make_png(text: str, tail: bytes = b"") -> bytes:
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"tEXt", b"Comment\0" + text.encode("latin-1", "replace")) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"") + tail


def make_jpeg(tags: dict[int, str], size: tuple[int, int] = (8, 6), thumb: bytes = b"") -> bytes:
    """A JPEG's frame without a scan: text tags in EXIF data, a size, a thumbnail."""
    values, entries, at = b"", b"", 8 + 2 + 12 * len(tags) + 4
    for tag in sorted(tags):
        v = tags[tag].encode() + b"\0"
        entries += struct.pack("<HHI", tag, 2, len(v)) + (struct.pack("<I", at + len(values)) if len(v) > 4 else v.ljust(4, b"\0"))
        values += v if len(v) > 4 else b""
    after = at + len(values) if thumb else 0
    second = struct.pack("<H", 2) + struct.pack("<HHII", 0x0201, 4, 1, after + 30) + struct.pack("<HHII", 0x0202, 4, 1, len(thumb)) + struct.pack("<I", 0) + thumb if thumb else b""
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + entries + struct.pack("<I", after) + values + second
    segment = lambda marker, data: b"\xff" + bytes([marker]) + struct.pack(">H", len(data) + 2) + data
    return b"\xff\xd8" + segment(0xE1, b"Exif\0\0" + tiff) + segment(0xC0, struct.pack(">BHHB", 8, size[1], size[0], 1) + b"\1\x11\0") + b"\xff\xd9"


@query("zip_members", """SELECT 'p/' || page_id || '.docx' AS path, 'zip_member' AS kind, 'word/document.xml' AS name, CAST(octet_length(encode(coalesce(url, ''))) AS BIGINT) AS n FROM pages UNION ALL SELECT 'p/' || page_id || '.docx', 'zip_member', 'docProps/core.xml', 26 FROM pages""")
def zip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _as_files(spark, sf_dir, lambda i, u, h: make_zip({"word/document.xml": (u or "").encode(), "docProps/core.xml": b"<dc:creator>c</dc:creator>"}), ".docx", "ooxml")
    return containers.parts(f).select("path", "kind", "name", "n")


# addresses of pages hold no name that a PDF reader looks for, so the keywords are those that make_pdf writes
_PDF_SQL = """SELECT file, 'active_url' AS category, sub AS subcategory, coalesce(url, '') AS evidence, 'critical' AS severity, 0.9::DOUBLE AS confidence FROM {t}, (VALUES ('pdf_stream_url'), ('pdf_raw_url'), ('uri_action')) v(sub) WHERE url IS NOT NULL
UNION ALL SELECT file, 'open_action', '/OpenAction', '/OpenAction            1', 'critical', 0.8::DOUBLE FROM {t}"""


@query(
    "archive_recursion",
    f"""WITH z AS (SELECT 'p/' || page_id || '.zip' AS file, url, html FROM pages), p AS (SELECT file || '!/a.zip!/b.pdf' AS file, url FROM z), h AS (SELECT file || '!/c.html' AS path, coalesce(html, '') AS raw FROM z)
SELECT file, 'archive_nested' AS category, 'archive' AS subcategory, '[''a.zip'', ''c.html'']' AS evidence, 'info' AS severity, 0.5::DOUBLE AS confidence FROM z UNION ALL SELECT file || '!/a.zip', 'archive_nested', 'archive', '[''b.pdf'']', 'info', 0.5::DOUBLE FROM z
UNION ALL {_PDF_SQL.format(t="p")} UNION ALL {_html_sql("h")}""",
)
def archive_recursion(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _as_files(spark, sf_dir, lambda i, u, h: make_zip({"a.zip": make_zip({"b.pdf": make_pdf(u or "")}), "c.html": (h or "").encode()}), ".zip", "archive")
    return detect.remote_references(f).select(*COLS)


@query("mime_parts", """WITH t AS (SELECT 'p/' || page_id || '.eml' AS file, url FROM pages WHERE url IS NOT NULL) SELECT file, 'suspicious_metadata_field' AS category, 'email_header/x_mailer' AS subcategory, url AS evidence, 'info' AS severity, 0.5::DOUBLE AS confidence FROM t UNION ALL SELECT file, 'tracking_pixel', 'eml_beacon', url, 'critical', 0.9::DOUBLE FROM t""")
def mime_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _as_files(spark, sf_dir, lambda i, u, h: b"Subject: x\nX-Mailer: " + (u or "").encode() + b'\nContent-Type: text/html\n\n<img src="' + (u or "").encode() + b'" width="1">', ".eml", "email")
    return detect.remote_references(f).select(*COLS)


@query("pdf_keywords", f"WITH t AS (SELECT 'p/' || page_id || '.pdf' AS file, url FROM pages) {_PDF_SQL.format(t='t')}")
def pdf_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.remote_references(_as_files(spark, sf_dir, lambda i, u, h: make_pdf(u or ""), ".pdf", "pdf")).select(*COLS)


@query("keyword_counts", f"SELECT k AS keyword, CAST(CASE k WHEN '/OpenAction' THEN (SELECT count(*) FROM pages) WHEN '/JS' THEN (SELECT count(*) FROM pages WHERE page_id % 3 = 0) ELSE 0 END AS BIGINT) AS n, CAST(CASE k WHEN '/OpenAction' THEN (SELECT count(*) FROM pages) WHEN '/JS' THEN (SELECT count(*) FROM pages WHERE page_id % 3 = 0) ELSE 0 END AS BIGINT) AS files FROM (VALUES {', '.join(f"('{k}')" for k in containers.KEYWORDS)}) v(k)")
def keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.keyword_counts(_as_files(spark, sf_dir, lambda i, u, h: make_pdf(u or "") + (b"3 0 obj\n<< /J#53 (x) >>\nendobj\n" if i % 3 == 0 else b""), ".pdf", "pdf"))


@query("png_chunks", """SELECT 'p/' || page_id || '.png' AS file, 'steg_carrier' AS category, 'pngcheck' AS subcategory, ' 1 bytes after IEND' AS evidence, 'high' AS severity, 0.7::DOUBLE AS confidence FROM pages WHERE page_id % 2 = 1""")
def png_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.stego(_as_files(spark, sf_dir, lambda i, u, h: make_png(u or "", b"x" if i % 2 else b""), ".png", "image")).select(*COLS)


@query("image_tags", """SELECT 'p/' || page_id || '.jpg' AS file, 'metadata_pii' AS category, 'artist' AS subcategory, url AS evidence, 'medium' AS severity, 0.6::DOUBLE AS confidence FROM pages WHERE url IS NOT NULL UNION ALL SELECT 'p/' || page_id || '.jpg', 'active_url', 'software', url, 'high', 0.7::DOUBLE FROM pages WHERE url IS NOT NULL""")
def image_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _as_files(spark, sf_dir, lambda i, u, h: make_jpeg({0x0131: u or "", 0x013B: u or ""}), ".jpg", "image")
    return metadata.metadata_findings(f, metadata.metadata(f)).select(*COLS)


@query("csv_files", """SELECT 'p/' || page_id || '.csv' AS file, 'formula_injection' AS category, 'csv_formula' AS subcategory, '=HYPERLINK("' || url || '")' AS evidence, 'medium' AS severity, 0.8::DOUBLE AS confidence FROM pages WHERE url IS NOT NULL UNION ALL SELECT 'p/' || page_id || '.csv', 'active_url', 'csv_formula_url', url, 'critical', 0.9::DOUBLE FROM pages WHERE url IS NOT NULL""")
def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page in a hundred has many thousand cells before its formula."""
    f = _as_files(spark, sf_dir, lambda i, u, h: b"-1,-2\n" * (15_000 if i % 100 == 0 else 2) + b'"=HYPERLINK(""' + (u or "").encode() + b'"")"\n', ".csv", "csv")
    return detect.remote_references(f).select(*COLS)

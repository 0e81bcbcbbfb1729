"""Allow and deny rules, and stage artefacts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..operators.report import Rules
from ..schema import FINDING, SEQ


def parse_rules(name: str, text: str) -> Rules:
    """.json: an object {domains, urls, files, metadata} or a list of domains; else a domain a line, # begins a comment line."""
    if name.endswith(".json"):
        data = json.loads(text)
        if isinstance(data, list):
            return Rules(domains=[str(x) for x in data])
        return Rules(list(data.get("domains", [])), list(data.get("urls", [])), list(data.get("files", [])), {k: list(v) for k, v in data.get("metadata", {}).items()})
    return Rules(domains=[x.strip() for x in text.splitlines() if x.strip() and not x.strip().startswith("#")])


def load_rules(path: str | None) -> Rules:
    """Rules of a file; none if there is no file or it cannot be parsed."""
    if not path:
        return Rules()
    import pyarrow.fs as pafs

    try:
        fs, p = pafs.FileSystem.from_uri(path)
        with fs.open_input_stream(p) as f:
            return parse_rules(path, f.read().decode("utf-8"))
    except (OSError, ValueError, AttributeError, TypeError):
        return Rules()


def rule_rows(rules: Rules, kind: str) -> list[tuple[str, str, str, str]]:
    """(list, kind, key, value) rows of rules."""
    rows = [(kind, k, "", v) for k, vs in (("domain", rules.domains), ("url", rules.urls), ("file", rules.files)) for v in vs]
    return rows + [(kind, "metadata", k, v) for k, vs in rules.metadata.items() for v in vs]


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a JSON-lines artefact; none if it is missing."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(f"{FINDING}, seq {SEQ}").json(path)
    except AnalysisException:
        return spark.createDataFrame([], f"{FINDING}, seq {SEQ}")


def inventory_of(findings: DataFrame) -> DataFrame:
    """File records from the extras of inventory findings."""
    from pyspark.sql import functions as F

    x = F.col("extras")
    return findings.where("stage = 'inventory'").select(x["path"].alias("path"), x["sha256"].alias("sha256"), x["size"].cast("long").alias("size"), F.to_timestamp(x["mtime"], "yyyy-MM-dd'T'HH:mm:ss").alias("mtime"), x["mime"].alias("mime"), x["bucket"].alias("bucket"), x["extension"].alias("extension"))

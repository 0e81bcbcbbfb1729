"""Report sinks: JSON lines, CSV, SARIF, standard output.

The executors can write a report as folders of parts, ordered by part name, at a URI that they share. One local file is an option for
reports that a person reads: its rows are streamed through the driver, which never holds them all.
"""

from __future__ import annotations

import csv
import json
import sys
from collections.abc import Iterator
from pathlib import Path
from typing import TextIO

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .. import __version__
from ..operators.report import sarif_rules
from ..schema import COLUMNS
from ..vocab import CATEGORIES, SARIF_LEVELS

CSV_COLUMNS = [*COLUMNS[:-1], "extras_json"]


def _rows(findings: DataFrame) -> Iterator[Row]:
    return findings.select(*COLUMNS).toLocalIterator(prefetchPartitions=True)


def _dump(f: TextIO, rows: Iterator[Row]) -> int:
    n = 0
    for r in rows:
        f.write(json.dumps(r.asDict(recursive=True), ensure_ascii=False) + "\n")
        n += 1
    return n


def write_jsonl(findings: DataFrame, path: Path) -> int:
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", encoding="utf-8") as f:
        return _dump(f, _rows(findings))


def write_csv(findings: DataFrame, path: Path) -> int:
    path.parent.mkdir(parents=True, exist_ok=True)
    n = 0
    with path.open("w", encoding="utf-8", newline="") as f:
        w = csv.writer(f)
        w.writerow(CSV_COLUMNS)
        for r in _rows(findings):
            w.writerow([*(r[c] for c in COLUMNS[:-1]), json.dumps(r["extras"] or {}, ensure_ascii=False)])
            n += 1
    return n


def _rule(category: str, subcategory: str) -> str:
    return f"docsignal/{category}/{subcategory}" if subcategory else f"docsignal/{category}"


def write_sarif(findings: DataFrame, path: Path) -> int:
    """SARIF 2.1.0: the rules, in order of their first finding, and then results one by one."""
    path.parent.mkdir(parents=True, exist_ok=True)
    head, tail = sarif_frame(findings)
    n = 0
    with path.open("w", encoding="utf-8") as f:
        f.write(head)
        for r in _rows(findings):
            f.write((",\n" if n else "\n") + json.dumps(result_json(r.asDict(recursive=True)), ensure_ascii=False))
            n += 1
        f.write(tail + "\n")
    return n


def result_json(r) -> dict:
    """The SARIF result of a row (a mapping)."""
    return {
        "ruleId": _rule(r["category"], r["subcategory"]),
        "level": SARIF_LEVELS.get(r["severity"], "note"),
        "message": {"text": r["finding"]},
        "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["file"], "properties": {"sha256": r["sha256"]}}}}],
        "partialFingerprints": {"evidence": r["evidence"]} if r["evidence"] else {},
        "properties": {"bucket": r["bucket"], "file_type": r["file_type"], "stage": r["stage"], "subcategory": r["subcategory"], "tool": r["tool"], "confidence": r["confidence"], "extras": dict(r["extras"] or {})},
    }


def write_parts(findings: DataFrame, uri: str, fmt: str) -> None:
    """Write json, csv or sarif as a folder of parts. Each part of sarif is a whole SARIF document with all rules and its own results."""
    if fmt == "json":
        findings.select(*COLUMNS).write.mode("overwrite").option("ignoreNullFields", "false").json(uri)
    elif fmt == "csv":
        rows = findings.select(*COLUMNS[:-1], F.to_json(F.coalesce("extras", F.create_map().cast("map<string,string>"))).alias("extras_json"))
        rows.write.mode("overwrite").option("header", "true").option("escape", '"').option("emptyValue", "").csv(uri)
    else:
        head, tail = sarif_frame(findings)

        def run(batches):
            first = True
            for batch in batches:
                lines = [json.dumps(result_json(r), ensure_ascii=False) for r in batch.to_pylist()]
                if lines:
                    yield pa.RecordBatch.from_pydict({"value": [(head if first else ",") + ",\n".join(lines)]})
                    first = False
            yield pa.RecordBatch.from_pydict({"value": [(head if first else "") + tail]})

        findings.select(*COLUMNS).mapInArrow(run, "value string").write.mode("overwrite").text(uri)


def sarif_frame(findings: DataFrame) -> tuple[str, str]:
    """What comes before and after the results: the rules, in order of their first finding."""
    rules = [
        {"id": r.rule_id, "name": r.category, "shortDescription": {"text": CATEGORIES.get(r.category, r.category)}, "fullDescription": {"text": r.finding}, "defaultConfiguration": {"level": SARIF_LEVELS.get(r.severity, "note")}}
        for r in sarif_rules(findings).orderBy("seq").collect()  # one row a rule
    ]
    head = {"$schema": "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/Schemata/sarif-schema-2.1.0.json", "version": "2.1.0"}
    run = {"tool": {"driver": {"name": "docsignal", "version": __version__, "rules": rules}}}
    return json.dumps(head)[:-1] + ', "runs": [' + json.dumps(run, ensure_ascii=False)[:-1] + ', "results": [', "]}]}"


def write_stdout(findings: DataFrame) -> int:
    return _dump(sys.stdout, _rows(findings))


def write_report(findings: DataFrame, outdir: Path, fmt: str = "json", stdout: bool = False, parts: str | None = None) -> dict[str, int]:
    """Write json, csv, sarif or all; counts by sink. The report is computed once and kept for all of them. With `parts`, a URI, the
    executors write folders <parts>.json and so on there instead of one local file each."""
    if fmt not in ("json", "csv", "sarif", "all"):
        raise ValueError(f"unknown format {fmt}")
    kept, counts = findings.persist(), {}
    try:
        if stdout:
            counts["stdout"] = write_stdout(kept)
        for name, write in (("json", write_jsonl), ("csv", write_csv), ("sarif", write_sarif)):
            if fmt in (name, "all"):
                if parts:
                    write_parts(kept, f"{parts}.{name}", name)
                    counts[name] = kept.count()
                else:
                    counts[name] = write(kept, outdir / f"docsignal-report.{name}")
    finally:
        kept.unpersist()
    return counts

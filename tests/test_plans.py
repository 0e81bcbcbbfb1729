import json

import pytest
from pyspark.sql import functions as F

from docsignal.plans import pipeline, sinks
from docsignal.plans.journal import Journal
from docsignal.sources.files import read_files
from docsignal.sources.rules import inventory_of, load_rules, parse_rules, read_findings, rule_rows
from docsignal.streaming import incremental


@pytest.fixture
def source(tmp_path):
    d = tmp_path / "src"
    (d / "sub").mkdir(parents=True)
    (d / "a.html").write_text('<img src="https://one.test/p" width="1">')
    (d / "sub" / ".hidden.html").write_text('<a href="https://two.test/">')
    (d / "_x.csv").write_text('=HYPERLINK("https://three.test/")\n')
    return d


def test_files_sees_hidden_names(spark, source):
    rows = {r.path.rsplit("/", 1)[1]: r for r in read_files(spark, str(source)).collect()}
    assert set(rows) == {"a.html", ".hidden.html", "_x.csv"}
    import hashlib

    assert rows["a.html"].sha256 == hashlib.sha256((source / "a.html").read_bytes()).hexdigest()
    assert read_files(spark, str(source), limit=3).where("content is not null").count() == 0


def test_scan_report_resume(spark, source, tmp_path, capsys):
    out = tmp_path / "out"
    o = pipeline.Options(fmt="all")
    assert pipeline.scan(spark, str(source), out, o) == 0
    rows = [json.loads(x) for x in (out / "docsignal-report.json").read_text().splitlines()]
    assert {"tracking_pixel", "formula_injection", "inventory"} <= {r["category"] for r in rows}
    assert rows[0]["severity"] == "critical"
    assert (out / "docsignal-report.csv").read_text().splitlines()[0] == ",".join(sinks.CSV_COLUMNS)
    sarif = json.loads((out / "docsignal-report.sarif").read_text())
    assert len(sarif["runs"][0]["results"]) == len(rows) and sarif["runs"][0]["tool"]["driver"]["rules"]
    journal = Journal(out, str(source))
    before = {k: journal.last(k)["at"] for k in pipeline.order()}
    assert pipeline.scan(spark, str(source), out, o, resume=True) == 0
    assert {k for k in pipeline.order() if journal.last(k)["at"] != before[k]} == {"report"}
    assert [r["code"] for r in journal.scans()] == [0, 0]
    inv = inventory_of(spark.read.parquet(f"file://{out}/inventory.parquet"))
    assert inv.count() == 3 and inv.where("size is null or bucket is null").count() == 0


def test_stage_failure_and_single_stage(spark, source, tmp_path, monkeypatch):
    out = tmp_path / "out"
    assert pipeline.scan(spark, str(source), out, stages=["uniqueness"]) == 0
    monkeypatch.setitem(pipeline.REGISTRY, "stego", lambda ctx: 1 / 0)
    assert pipeline.scan(spark, str(source), out, stages=["stego"]) == 4
    assert Journal(out, str(source)).scans()[-1]["code"] == 4
    with pytest.raises(FileNotFoundError):
        pipeline.run_report(pipeline.Context(spark, "", tmp_path / "none", pipeline.Options()))


def test_artefacts_elsewhere(spark, source, tmp_path):
    o = pipeline.Options(artefacts=f"file://{tmp_path}/shared")
    assert pipeline.scan(spark, str(source), tmp_path / "out", o, stages=["inventory", "stego", "report"]) == 0
    assert (tmp_path / "shared" / "inventory.parquet").exists() and (tmp_path / "out" / "docsignal-report.json").exists()
    assert not (tmp_path / "out" / "inventory.parquet").exists()


def test_guard(tmp_path):
    a, b = Journal(tmp_path, "x"), Journal(tmp_path, "x")
    with a.guarded():
        with pytest.raises(SystemExit) as e, b.guarded():
            pass
        assert e.value.code == 5
    with b.guarded():
        pass


def test_journal_subjects_and_torn_lines(tmp_path):
    j = Journal(tmp_path, "x", {"a": 1})
    assert j.begin(["scan"], ["inventory"]) == 1 and j.scans()[0]["code"] is None
    j.stage("inventory", 0, "t")
    assert Journal(tmp_path, "x", {"a": 1}).done("inventory")
    assert not Journal(tmp_path, "y", {"a": 1}).done("inventory") and not Journal(tmp_path, "x", {"a": 2}).done("inventory")
    with j.events_path.open("a") as f:
        f.write('{"event": "stage_en')  # killed while writing
    j.end(0)
    assert j.done("inventory") and j.scans()[0]["code"] == 0
    j.stage("inventory", 4, "t")
    assert not j.done("inventory") and Journal(tmp_path, "x").begin([], []) == 2


def test_listing_by_folder(spark, tmp_path):
    """Folders are listed level by level; heads are enough to classify files of any size; only wanted files are opened."""
    from docsignal.sources import files as fs

    src = tmp_path / "src"
    for k in range(12):
        (src / f"d{k % 3}" / "e").mkdir(parents=True, exist_ok=True)
        (src / f"d{k % 3}" / "e" / f".f{k}").write_bytes(b"%PDF-1" + b"x" * 2000)
    (src / "top.html").write_text("<b>")
    tables = iter(range(100))
    save = lambda df, k: (df.write.parquet(p := f"file://{tmp_path}/l{next(tables)}"), spark.read.parquet(p))[1]
    listed = fs.listing(spark, str(src), save)
    got = fs.classify(fs.hashed(listed, str(src)))
    assert {(r.path.rsplit("/", 1)[1], r.bucket, r.size) for r in got.collect()} == {("top.html", "html", 3), *((f".f{k}", "pdf", 2006) for k in range(12))}
    whole = {r.path: r.sha256 for r in fs.read_files(spark, str(src)).collect()}
    assert {r.path: r.sha256 for r in got.collect()} == whole
    back = fs.with_content(got.where("bucket = 'html'"), str(src)).collect()
    assert [bytes(r.content) for r in back] == [b"<b>"]
    assert fs.with_content(got, str(src), limit=100).where("content is not null").count() == 1
    empty = tmp_path / "none"
    empty.mkdir()
    assert fs.hashed(fs.listing(spark, str(empty), save), str(empty)).count() == 0


def test_report_in_parts(spark, source, tmp_path):
    o = pipeline.Options(fmt="all", parts=True, artefacts=f"file://{tmp_path}/shared", extract=f"file://{tmp_path}/objects")
    assert pipeline.scan(spark, str(source), tmp_path / "out", o) == 0
    rows = spark.read.parquet(f"file://{tmp_path}/shared/findings.parquet").count()
    assert spark.read.json(f"file://{tmp_path}/shared/report.json").count() == rows
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"file://{tmp_path}/shared/report.csv").count() == rows
    parts = [json.loads(p.read_text()) for p in sorted((tmp_path / "shared" / "report.sarif").glob("part-*"))]
    assert sum(len(p["runs"][0]["results"]) for p in parts) == rows and not list((tmp_path / "out").glob("docsignal-report*"))


def test_rules(tmp_path):
    r = parse_rules("r.json", '{"domains": ["d"], "urls": ["u"], "files": ["f"], "metadata": {"author": ["x"]}}')
    assert sorted(rule_rows(r, "allow")) == [("allow", "domain", "", "d"), ("allow", "file", "", "f"), ("allow", "metadata", "author", "x"), ("allow", "url", "", "u")]
    assert parse_rules("r.json", '["d"]').domains == ["d"]
    assert parse_rules("r.txt", "# c\n d \n\n").domains == ["d"]
    (tmp_path / "bad.json").write_text("{")
    assert load_rules(str(tmp_path / "bad.json")).domains == [] and load_rules(None).files == [] and load_rules(str(tmp_path / "none")).urls == []


def test_missing_artefact(spark, tmp_path):
    assert read_findings(spark, str(tmp_path / "none")).count() == 0


def test_capabilities_and_mount(spark, tmp_path):
    assert not pipeline.missing()
    assert pipeline.capabilities(spark).where("tier = 'required' and not present").count() == 0
    m = tmp_path / "mounts"
    m.write_text("a / ext4 rw 0 0\nb /data ext4 ro,noatime 0 0\n")
    assert pipeline.read_only("/data/x", str(m)) is True and pipeline.read_only("/tmp", str(m)) is False
    assert pipeline.main(["deps"]) == 0


def test_register():
    @pipeline.register("own")
    def own(ctx):
        return None

    try:
        assert pipeline.order()[-2:] == ["own", "report"]
    finally:
        del pipeline.REGISTRY["own"]


def test_incremental(spark, tmp_path):
    src, out, cp = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    src.mkdir()
    (src / "a.html").write_text('<a href="https://one.test/">')
    incremental.detect_new(spark, str(src), str(out), str(cp))
    first = incremental.current_report(spark, str(out)).where("category = 'active_url'").collect()
    assert [(r.severity) for r in first] == ["critical"]
    (src / "b.html").write_text('<b><a href="https://one.test/">')
    incremental.detect_new(spark, str(src), str(out), str(cp))
    second = incremental.current_report(spark, str(out)).where("category = 'active_url'")
    assert [r.severity for r in second.collect()] == ["medium", "medium"]  # two files now


def test_link_counts(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:00:01", "a"), ("2024-01-01 00:00:02", "a"), ("2024-01-01 00:06:00", "b")], "ts string, domain string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "e"))
    q = incremental.link_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("links").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.domain, r.n) for r in spark.table("links").collect()) == [("a", 2), ("b", 1)]


def test_large_containers_are_read(spark, tmp_path):
    """Files over the text limit: archives and documents are opened where they lie, PDF keywords are counted, the rest is told."""
    import zipfile

    from docsignal.operators import detect, metadata
    from docsignal.sources.files import classify

    d, pad = tmp_path / "big", b"a" * (51 << 20)
    d.mkdir()
    with zipfile.ZipFile(d / "a.zip", "w") as z:
        z.writestr("in.html", '<a href="https://zip.test/x">')
        z.writestr("m.bin", pad)
    with zipfile.ZipFile(d / "b.docx", "w") as z:
        z.writestr("word/document.xml", "<w>https://docx.test/x</w>")
        z.writestr("docProps/core.xml", "<c><dc:creator>Ann</dc:creator></c>")
        z.writestr("media.bin", pad)
    (d / "c.pdf").write_bytes(b"%PDF-1.4\n1 0 obj\n<< /JavaScript 2 0 R >>\nendobj\n%" + pad)
    (d / "e.csv").write_bytes(pad)
    files = classify(read_files(spark, str(d)))
    assert files.where("content is not null").count() == 0
    rows = detect.remote_references(files, source=str(d)).select("file", "category", "evidence", "finding").collect()
    said = {(r.file.rsplit("/", 1)[1], r.evidence) for r in rows}
    assert ("in.html", "https://zip.test/x") in said and ("b.docx", "https://docx.test/x") in said
    assert any(r.file.endswith("c.pdf") and r.category == "javascript" for r in rows)
    for name in ("b.docx", "c.pdf", "e.csv"):
        assert any(r.file.endswith(name) and "over the" in f"{r.finding}{r.evidence}" for r in rows), name
    tags = {r.path.rsplit("/", 1)[1]: r.tags for r in metadata.metadata(files, str(d)).collect()}
    assert "Ann" in tags["b.docx"].values()

"""The scan: stages over a source folder, each a Parquet artefact that the next ones read; resumable and locked."""

from __future__ import annotations

import argparse
import importlib.util
import logging
import shutil
import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect, metadata, report, uniqueness
from ..operators.report import Rules
from ..ship import ship
from ..sources.files import classify, hashed, listing, with_content
from ..sources.rules import load_rules
from ..vocab import MAX_DEPTH, MIN_CLUSTER, SEVERITIES, STAGES
from .sinks import write_report
from .journal import EXIT_DEPENDENCY, EXIT_OK, EXIT_STAGE, Journal, moment


@dataclass
class Options:
    specialized: bool = False
    max_depth: int = MAX_DEPTH
    least_cluster: int = MIN_CLUSTER
    fuzzy: bool = False
    compat: bool = False
    allow: Rules = field(default_factory=Rules)
    deny: Rules = field(default_factory=Rules)
    least: str = "info"
    fmt: str = "json"
    stdout: bool = False
    strict_host: bool = False
    #: a URI that all executors share, under which the embedded stage writes the objects that it finds; not written if not given
    extract: str | None = None
    #: where stage tables go, a URI that all executors share; the output folder if not given, which a single machine alone may do
    artefacts: str | None = None
    #: whether report sinks write a folder of parts beside the stage tables, by the executors, instead of one local file
    parts: bool = False


@dataclass
class Context:
    spark: SparkSession
    source: str
    outdir: Path
    options: Options

    def path(self, name: str) -> str:
        master = self.spark.sparkContext.master
        if not self.options.artefacts and (not master.startswith("local") or master.startswith("local-cluster")):
            raise ValueError("on a cluster, name a URI that all executors share for the stage tables (--artefacts)")
        return f"{(self.options.artefacts or f'file://{self.outdir.resolve()}').rstrip('/')}/{name}.parquet"

    def exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def read_source(self) -> None:
        """List, hash and classify the source once, into the table `files`."""

        def level(df: DataFrame, k: int) -> DataFrame:
            self.save(df, f"listing/level{k}")
            return self.artefact(f"listing/level{k}")

        listed = listing(self.spark, self.source, level)
        self.save(classify(hashed(listed, self.source), self.options.specialized).drop("content"), "files")

    def files(self, *buckets: str, extensions: tuple[str, ...] = ()) -> DataFrame:
        """Records of the files of some buckets, or with some extensions, with their content: no other file is opened."""
        return with_content(self.artefact("files").where(F.col("bucket").isin(*buckets) | F.col("extension").isin(*extensions)), self.source)

    def artefact(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def save(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(self.path(name))


LOG = logging.getLogger("docsignal")


def log_to(path: Path) -> logging.Handler:
    """Append the run's log, with times, to a file; the handler is the caller's to remove."""
    path.parent.mkdir(parents=True, exist_ok=True)
    h = logging.FileHandler(path, encoding="utf-8")
    h.setFormatter(logging.Formatter("%(asctime)s %(message)s", "%Y-%m-%dT%H:%M:%S"))
    LOG.addHandler(h)
    LOG.setLevel(logging.INFO)
    return h


Builder = Callable[[Context], DataFrame | None]
REGISTRY: dict[str, Builder] = {}


def register(name: str) -> Callable[[Builder], Builder]:
    """Add a stage: a function from the context to a table of findings. Stages beyond the fixed ones run before the report."""

    def put(f: Builder) -> Builder:
        REGISTRY[name] = f
        return f

    return put


@register("inventory")
def _inventory(ctx: Context) -> DataFrame:
    ctx.read_source()
    return detect.inventory_findings(ctx.artefact("files"))


@register("metadata")
def _metadata(ctx: Context) -> DataFrame:
    ctx.save(metadata.metadata(ctx.files(*metadata.BUCKETS), ctx.source), "tags")
    return metadata.metadata_findings(ctx.artefact("files"), ctx.artefact("tags"))


@register("remote-refs")
def _remote(ctx: Context) -> DataFrame:
    return detect.remote_references(ctx.files(*detect.BUCKETS, extensions=detect.EXTENSIONS), ctx.options.compat, ctx.options.max_depth, ctx.options.specialized, ctx.source)


@register("embedded")
def _embedded(ctx: Context) -> DataFrame:
    return detect.embedded(ctx.files("pdf", "ooxml", "ole", "rtf"), ctx.source, ctx.options.extract)


@register("stego")
def _stego(ctx: Context) -> DataFrame:
    return detect.stego(ctx.files("image"), ctx.source)


@register("uniqueness")
def _uniqueness(ctx: Context) -> DataFrame:
    o = ctx.options
    return uniqueness.uniqueness(ctx.artefact("files"), ctx.artefact("tags"), o.fuzzy, o.least_cluster, o.compat, ctx.source)


def order() -> list[str]:
    """Stages in the order in which they run."""
    return [*STAGES[:-1], *(s for s in REGISTRY if s not in STAGES), STAGES[-1]]


def run_report(ctx: Context, sources: list[str] | None = None) -> dict[str, int]:
    o = ctx.options
    names = [s for s in sources or order()[:-1] if ctx.exists(s)]
    if not names:
        raise FileNotFoundError(f"no stage artefacts in {ctx.outdir}")
    ctx.save(report.dedup(report.union_all([ctx.artefact(s) for s in names])), "findings")  # read twice: for the domains and for the rows
    table = report.ordered(report.threshold(report.evaluate(ctx.spark, ctx.artefact("findings"), o.allow, o.deny, o.strict_host), o.least))
    return write_report(table, ctx.outdir, o.fmt, o.stdout, ctx.path("report").removesuffix(".parquet") if o.parts else None)


def scan(spark: SparkSession, source: str, outdir: str | Path, options: Options | None = None, stages: list[str] | None = None, resume: bool = False, force: bool = False, args: list[str] | None = None) -> int:
    """Run the stages and return an exit code: 0, 4 if a stage failed, 5 (as SystemExit) if the folder is locked.

    A stage runs if forced, if not resuming, or if it has not ended well for this source and these options. The report always runs.
    """
    options = options or Options()
    ship(spark)
    ctx = Context(spark, source, Path(outdir), options)
    journal = Journal(ctx.outdir, source, {k: v for k, v in vars(options).items() if k not in ("fmt", "stdout", "least", "allow", "deny", "parts")})
    with journal.guarded():
        handler = log_to(ctx.outdir / "docsignal.log")
        try:
            wanted = [s for s in order() if s in (stages or order())]
            journal.begin(args or [], wanted)
            if wanted and wanted[0] not in ("inventory", "report") and not ctx.exists("files"):
                wanted = ["inventory", *wanted]
            if "uniqueness" in wanted and "metadata" not in wanted and not ctx.exists("tags"):
                wanted.insert(wanted.index("uniqueness"), "metadata")
            code = EXIT_OK
            for name in wanted:
                if name != "report" and resume and not force and journal.done(name):
                    continue
                begun, code = moment(), _run_stage(ctx, name)
                journal.stage(name, code, begun, f"{name}.parquet" if code == EXIT_OK else "")
                if code != EXIT_OK:
                    break
            journal.end(code)
            return code
        finally:
            LOG.removeHandler(handler)
            handler.close()


def _run_stage(ctx: Context, name: str) -> int:
    LOG.info("stage %s started", name)
    try:
        if name == "report":
            run_report(ctx)
        else:
            ctx.save(REGISTRY[name](ctx), name)
    except Exception as e:  # noqa: BLE001 the journal records the failure of any stage
        sys.stderr.write(f"stage {name} failed: {e}\n")
        LOG.info("stage %s failed: %s", name, str(e)[:2000])
        return EXIT_STAGE
    LOG.info("stage %s completed", name)
    return EXIT_OK


# ---- capabilities --------------------------------------------------------------------------------------------------------

#: (name, tier, what it is for, how to install it): only what some code here uses
CAPABILITIES = [
    ("pyspark", "required", "execution", "pip install pyspark"),
    ("pyarrow", "required", "batches and file systems", "pip install pyarrow"),
    ("PIL", "optional", "pixels of JPEG and TIFF pictures, for thumbnails and pixel differences", "pip install pillow"),
]


def present(name: str) -> bool:
    return bool(shutil.which(name)) or (name.isidentifier() and importlib.util.find_spec(name) is not None)


def capabilities(spark: SparkSession) -> DataFrame:
    """(name, tier, purpose, hint, present) of libraries and tools."""
    return spark.createDataFrame([(*c, present(c[0])) for c in CAPABILITIES], "name string, tier string, purpose string, hint string, present boolean")


def missing(strict: bool = False) -> list[tuple[str, str]]:
    """(name, hint) of the required ones that are absent; strict takes the optional ones for required."""
    return [(n, hint) for n, t, _, hint in CAPABILITIES if (strict or t == "required") and not present(n)]


def read_only(path: str, mounts: str = "/proc/mounts") -> bool | None:
    """Whether the mount that holds a local path is read-only; None if unknown."""
    best, ro = "", None
    try:
        for line in Path(mounts).read_text().splitlines():
            _, point, _, opts = line.split()[:4]
            if str(Path(path).resolve()).startswith(point.rstrip("/") + "/") or point == "/":
                if len(point) >= len(best):
                    best, ro = point, "ro" in opts.split(",")
    except (OSError, ValueError):
        return None
    return ro


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="docsignal", description="Screen documents for call-home signals and per-recipient fingerprints.")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "stage", "report"):
        c = sub.add_parser(name)
        if name == "stage":
            c.add_argument("name", choices=STAGES)
        if name != "report":
            c.add_argument("datasource")
            for flag in ("--resume", "--force", "--fuzzy", "--compat", "--enable-specialized"):
                c.add_argument(flag, action="store_true")
            c.add_argument("--max-archive-depth", type=int, default=MAX_DEPTH)
            c.add_argument("--min-cluster-size", type=int, default=MIN_CLUSTER)
            c.add_argument("--extract", help="URI under which embedded objects are written")
        c.add_argument("--outdir", default=".docsignal")
        c.add_argument("--artefacts", help="URI for stage tables that all executors share; the output folder by default")
        c.add_argument("--format", choices=["json", "csv", "sarif", "all"], default="json")
        c.add_argument("--stdout", action="store_true")
        c.add_argument("--parts", action="store_true", help="write the report as a folder of parts, by the executors")
        c.add_argument("--severity", choices=SEVERITIES, default="info")
        if name != "stage":
            c.add_argument("--allowlist")
            c.add_argument("--denylist")
    deps = sub.add_parser("deps")
    deps.add_argument("--strict", action="store_true")
    a = p.parse_args(argv)
    if a.command == "deps":
        gone = missing(a.strict)
        print("\n".join(f"missing: {n} ({hint})" for n, hint in gone) or "all present")
        return EXIT_DEPENDENCY if gone else EXIT_OK
    if missing():
        return EXIT_DEPENDENCY
    spark = SparkSession.builder.appName("docsignal").getOrCreate()
    o = Options(artefacts=a.artefacts, parts=a.parts, least=a.severity, fmt=a.format, stdout=a.stdout, allow=load_rules(getattr(a, "allowlist", None)), deny=load_rules(getattr(a, "denylist", None)))
    if a.command == "report":
        run_report(Context(spark, "", Path(a.outdir), o))
        return EXIT_OK
    o.extract = a.extract
    o.specialized, o.max_depth, o.least_cluster, o.fuzzy, o.compat = a.enable_specialized, a.max_archive_depth, a.min_cluster_size, a.fuzzy, a.compat
    if read_only(a.datasource) is False:
        sys.stderr.write(f"{a.datasource} is not mounted read-only\n")
    return scan(spark, a.datasource if "://" in a.datasource else str(Path(a.datasource).resolve()), a.outdir, o, [a.name] if a.command == "stage" else None, a.resume, a.force, sys.argv[1:] if argv is None else argv)


if __name__ == "__main__":
    raise SystemExit(main())

"""What a Python worker holds of a batch, and what it sends back at once."""

import tracemalloc

import pyarrow as pa

from docsignal import queries
from docsignal.operators import metadata, uniqueness
from docsignal.sources import batches, containers


class Table:
    """Stands for a table: hands out the function that its tasks run."""

    def __init__(self, spark):
        self.sparkSession = spark

    def select(self, *_):
        return self

    where = select

    def mapInArrow(self, run, _):
        return run


def held(run, batch):
    """(most MB of Python objects, most MB of a batch, rows) of a function over one batch."""
    tracemalloc.start()
    sizes = [(b.nbytes, b.num_rows) for b in run(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 2**20, max(n for n, _ in sizes) / 2**20, sum(n for _, n in sizes)


def batch(contents, bucket, extension):
    n = len(contents)
    return pa.RecordBatch.from_arrays([pa.array([f"p/{i}{extension}" for i in range(n)]), pa.array(["0" * 64] * n), pa.array([bucket] * n), pa.array([extension] * n), pa.array(contents, pa.binary())], names=["path", "sha256", "bucket", "extension", "content"])


def test_batches_to_workers_are_bounded(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    table = batches.bounded(spark.range(0, 300, 1, 1).selectExpr("repeat('x', 100000) AS text"))
    got = [r.n for r in table.mapInArrow(sizes, "n long").collect()]
    assert sum(got) >= 30_000_000 and max(got) < 2 * batches.BATCH


def test_parts_of_many_pdfs(spark):
    run = containers.parts(Table(spark))
    python, arrow, rows = held(run, batch([queries.make_pdf(f"https://h/{i}") for i in range(6000)], "pdf", ".pdf"))
    assert rows == 6000 * 16 and python < 8 and arrow < 4


def test_pictures_are_taken_one_at_a_time(spark):
    pictures = batch([queries.make_png("c" * 10, b"x" * 200_000) for _ in range(200)], "image", ".png")
    python, _, rows = held(containers.parts(Table(spark)), pictures)
    assert rows == 200 * 4 and python < 4
    python, _, rows = held(metadata.metadata(Table(spark)), pictures.select(["path", "bucket", "extension", "content"]))
    assert rows == 200 and python < 4


def test_cells_of_a_large_file(spark):
    """Negative numbers are not sent, cells after them keep their places, and the text is not held whole in wide characters."""
    raw = b"-1,+cmd|x\n" + b"-1,-2\n" * 400_000 + b'"=HYPERLINK(""https://h/c"")"\n'
    run = containers.parts(Table(spark))
    got = [(r["part"], r["text"]) for b in run(iter([batch([raw], "csv", ".csv")])) for r in b.to_pylist()]
    assert got == [(1, "+cmd|x"), (800_002, '=HYPERLINK("https://h/c")')]
    python, arrow, _ = held(run, batch([raw], "csv", ".csv"))
    assert python < 8 and arrow < 1


def test_members_of_many_archives(spark):
    archives = batch([queries.make_zip({"a.zip": queries.make_zip({"b.pdf": b"x" * 1000}), "c.html": b"y" * 100_000}) for _ in range(400)], "archive", ".zip").select(["path", "content"])
    python, arrow, rows = held(containers.archive_members(Table(spark)), archives)
    assert rows == 400 * 3 and python < 8 and arrow < 3


def test_large_member_goes_alone(spark):
    archive = batch([queries.make_zip({"a.bin": b"x", "b.bin": bytes(3 * batches.BATCH), "c.bin": b"z"})], "archive", ".zip").select(["path", "content"])
    got = [[(r["path"], r["size"]) for r in b.to_pylist()] for b in containers.archive_members(Table(spark))(iter([archive]))]
    assert got == [[("p/0.zip!/a.bin", 1)], [("p/0.zip!/b.bin", 3 * batches.BATCH)], [("p/0.zip!/c.bin", 1)]]


def test_least_values_of_a_group(spark):
    """A task keeps the first values of each group, not all; what it hands on early loses none."""
    values = [f"v{(i * 7919) % 50_000:06d}" for i in range(50_000)]
    rows = pa.RecordBatch.from_arrays([pa.array([f"k{i % 3}" for i in range(50_000)]), pa.array([*values[:-1], None])], names=["k", "v"])
    want = {(k, v) for k in ("k0", "k1", "k2") for v in sorted({v for i, v in enumerate(values[:-1]) if f"k{i % 3}" == k})[:20]}
    for budget in (16 << 20, 1):
        got = [(r["k"], r["v"]) for b in uniqueness.least(Table(spark), ["k"], 20, budget)(iter([rows.slice(0, 25_000), rows.slice(25_000)])) for r in b.to_pylist()]
        assert want <= set(got) and len(got) <= 60 * (1 if budget > 1 else 3)


def test_field_differences_hold_no_values(spark):
    """Aggregates of fixed width, and a row that is there twice is no file without the field."""
    field = "array<struct<obj:string,ft:string,t:string,tu:string,v:string>>"
    rows = [("same", 2, "a", [("1 0", "/Tx", "n", None, "v")])] * 2 + [("other", 2, p, [("1 0", "/Tx", "n", None, p)]) for p in "ab"] + [("lacks", 2, "a", [("1 0", "/Tx", "n", "t", "v")]), ("lacks", 2, "b", [])]
    diffs = uniqueness.field_diffs(spark.createDataFrame(rows, f"cluster_id string, cluster_size long, path string, form_fields {field}"))
    got = {r.cluster_id: r.evidence for r in diffs.collect()}
    assert set(got) == {"other", "lacks"} and got["other"] == "field 'n' value differs (a: 'a', b: 'b')"
    assert got["lacks"].count("others: None") == 3 and "Expand" not in diffs._jdf.queryExecution().toString()

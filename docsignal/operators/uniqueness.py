"""Fingerprints: files that look alike by bucket, page count, producer and creator, but differ in a value per copy."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical, text_of, without_versions
from ..schema import HIT, findings, hit, info, place
from ..sources.batches import bounded, rows_of
from ..sources.containers import held as opened
from ..sources.containers import pdf_objects, zip_parts
from ..sources.files import with_content
from ..sources.pictures import decoded
from ..vocab import IDENTITY_TAGS, MAX_TEXT, MIN_CLUSTER

STAGE = "uniqueness"
C = F.col


def page_count(tags: Column) -> Column:
    return F.coalesce(tags["PDF:PageCount"], tags["PageCount"], tags["Pages"])


def cluster_key(bucket: Column, pages: Column, producer: Column, creator: Column, fuzzy: bool = False) -> Column:
    """bucket|pages=..|prod=..|creat=..; absent parts are left out. fuzzy drops version numbers."""
    clean = without_versions if fuzzy else (lambda c: c)
    part = lambda name, v: F.when(v != "", F.concat(F.lit(name), v))
    return F.concat_ws("|", bucket, part("pages=", pages), part("prod=", clean(producer)), part("creat=", clean(creator)))


def clusters(records: DataFrame, metadata: DataFrame, fuzzy: bool = False, least: int = MIN_CLUSTER) -> DataFrame:
    """records with cluster_id and cluster_size, of clusters with at least `least` members."""
    tags = metadata.select(C("path").alias("_p"), "tags", "form_fields")
    t = C("tags")
    joined = records.join(tags, C("path") == C("_p"), "left").drop("_p")
    keyed = joined.withColumn("cluster_id", cluster_key(C("bucket"), page_count(t), F.coalesce(F.nullif(t["PDF:Producer"], F.lit("")), t["Producer"]), F.coalesce(F.nullif(t["PDF:Creator"], F.lit("")), t["Creator"]), fuzzy))
    sizes = keyed.groupBy("cluster_id").agg(F.count("*").alias("cluster_size")).where(C("cluster_size") >= least)
    return keyed.join(sizes, "cluster_id")


DIFF = ["cluster_id", "field", "description", "evidence"]
#: as many different values as an evidence names; of more it gives the number
SHOWN = 20


def differing(rows: DataFrame, keys: list[str], sep: str) -> DataFrame:
    """(keys, evidence) of the groups of (keys, v) with several values: the first SHOWN values in order, and how many more there are.

    Values are made distinct before the shuffle and no group's values are gathered beyond those shown.
    """
    distinct = rows.groupBy(*keys, "v").agg(F.lit(1).alias("one"))
    kinds = distinct.groupBy(*keys).agg(F.count("*").alias("kinds")).where("kinds > 1")
    first = distinct.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("v"))).where(C("r") <= SHOWN)
    shown = first.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("v")), sep).alias("shown")).join(kinds, keys)
    more = F.when(C("kinds") > SHOWN, F.concat(F.lit(f"{sep}and "), (C("kinds") - SHOWN).cast("string"), F.lit(" more"))).otherwise("")
    return shown.select(*keys, F.concat("shown", more).alias("evidence"))


def text_diffs(members: DataFrame, raw: Column) -> DataFrame:
    """Clusters whose texts differ: only by blanks and line ends, or otherwise."""
    rows = members.select("cluster_id", F.sha2(raw, 256).alias("h"), F.sha2(canonical(raw), 256).alias("c"))
    # all equal, or any differ: minimum against maximum, so that no cluster's hashes are gathered
    agg = rows.groupBy("cluster_id").agg((F.min("h") != F.max("h")).alias("differ"), (F.min("c") == F.max("c")).alias("same")).where("differ")
    return agg.select(
        "cluster_id",
        F.when(C("same"), "canonicalization_diff").otherwise("raw_text_bytes").alias("field"),
        F.when(C("same"), "the same text with other blanks or line ends").otherwise("the texts are not the same").alias("description"),
        F.when(C("same"), "equal once blanks and line ends are made alike").otherwise("hashes of the texts are not equal").alias("evidence"),
    )


def tag_diffs(members: DataFrame) -> DataFrame:
    """Identifier tags with several non-empty values in a cluster."""
    keys = F.array(*[F.struct(F.lit(k).alias("k"), C("tags")[k].alias("v")) for k in IDENTITY_TAGS])
    rows = members.select("cluster_id", F.explode(keys).alias("t")).select("cluster_id", "t.*").where("v <> ''")
    return differing(rows, ["cluster_id", "k"], ", ").select("cluster_id", F.lower("k").alias("field"), F.concat(F.lit("each copy has its own "), C("k")).alias("description"), "evidence")


def size_diffs(members: DataFrame) -> DataFrame:
    """Image clusters with several dimensions."""
    t = C("tags")
    dim = F.concat(F.coalesce(t["ImageWidth"], t["ExifImageWidth"], F.lit("")), F.lit("x"), F.coalesce(t["ImageHeight"], t["ExifImageHeight"], F.lit("")))
    return differing(members.select("cluster_id", dim.alias("v")), ["cluster_id"], ", ").select("cluster_id", F.lit("image_dimensions").alias("field"), F.lit("the pictures are not of one size").alias("description"), "evidence")


def first_two(members: DataFrame) -> DataFrame:
    """(cluster_id, a, b): the first two paths of each cluster."""
    one = members.groupBy("cluster_id").agg(F.min("path").alias("a"))
    return members.join(one, "cluster_id").where(C("path") > C("a")).groupBy("cluster_id").agg(F.min("a").alias("a"), F.min("path").alias("b"))


def pixel_diffs(pairs: DataFrame, most: int = 1000) -> DataFrame:
    """Of pairs (cluster_id, left, right: contents) those of one size with some, but fewer than `most`, pixels that differ."""

    def run(batches):
        for batch in batches:
            out = []
            for cluster, left, right in rows_of(batch):
                a, b = (decoded(x) if x else None for x in (left, right))
                if a is not None and b is not None and a.shape == b.shape:
                    n = int((a != b).any(2).sum())
                    if 0 < n < most:
                        out.append((cluster, str(n)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], names=["cluster_id", "n"])

    found = bounded(pairs.select("cluster_id", "left", "right")).mapInArrow(run, "cluster_id string, n string")
    return found.select("cluster_id", F.lit("pixel_diff").alias("field"), F.concat("n", F.lit(" pixels of the first two pictures differ")).alias("description"), C("n").alias("evidence"))


def core_diffs(members: DataFrame, core: Column, compat: bool = False) -> DataFrame:
    """Clusters whose GUIDs, or whose revisions, differ; compat compares both in one set."""
    value = lambda name, p: F.when(core.rlike(p), F.concat(F.lit(name), F.regexp_extract(core, p, 1)))
    both = F.array(value("guid=", r"(?i)<(?:cp:|)guid[^>]*>([^<]+)<"), value("rev=", r"(?i)<(?:cp:|)revision[^>]*>([^<]+)<"))
    rows = members.select("cluster_id", "path", F.posexplode(both).alias("which", "v")).where("v is not null")
    whole = differing(rows.select("cluster_id", F.lit(0).alias("which") if compat else C("which"), "v"), ["cluster_id", "which"], " | ")
    return whole.groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_list("evidence")), " | ").alias("evidence")).select("cluster_id", F.lit("core_xml_guid_revision").alias("field"), F.lit("each copy has its own GUID or revision in core.xml").alias("description"), "evidence")


def least(rows: DataFrame, keys: list[str], most: int = SHOWN, budget: int = 16 << 20) -> DataFrame:
    """Rows (keys, v: strings) that hold the first `most` different values of each group, in one pass of each task: it holds `most` values a
    group, and hands on what it has found once that is over about `budget` bytes."""

    def run(batches):
        from bisect import bisect_left

        def told():
            out = [(*k, v) for k, found in held.items() for v in found]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(len(keys) + 1)], names=[*keys, "v"])

        held, size = {}, 0
        for batch in batches:
            for *key, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if v is None:
                    continue
                found = held.setdefault(tuple(key), [])
                if len(found) == most and v >= found[-1]:
                    continue
                at = bisect_left(found, v)
                if at == len(found) or found[at] != v:
                    found.insert(at, v)
                    size += len(v) + sum(map(len, key)) + 200
                    if len(found) > most:
                        size -= len(found.pop()) + sum(map(len, key)) + 200
            if size >= budget:
                yield told()
                held, size = {}, 0
        yield told()

    return bounded(rows.select(*keys, "v")).mapInArrow(run, ", ".join(f"{k} string" for k in [*keys, "v"]))


def field_diffs(members: DataFrame) -> DataFrame:
    """Form fields, aligned by name or else object, whose value, tooltip or name differs; a member without the field counts as None.

    Aggregates are of fixed width, values compared by 128 bits of hashes, so a task holds as much as there are fields, not files.
    """
    name = lambda f: F.coalesce(F.nullif(f["t"], F.lit("")), f["obj"])
    none = F.lit(None).cast("string")
    # each field, and once for each member and key a row that counts the member
    fields = F.transform("form_fields", lambda f: F.struct(name(f).alias("key"), f["v"].alias("v"), f["tu"].alias("tu"), f["t"].alias("t"), F.lit(False).alias("once")))
    once = F.transform(F.array_distinct(F.transform("form_fields", name)), lambda k: F.struct(k.alias("key"), none.alias("v"), none.alias("tu"), none.alias("t"), F.lit(True).alias("once")))
    rows = members.select("cluster_id", "cluster_size", "path", F.explode(F.concat(fields, once)).alias("f"))
    rows = rows.select("cluster_id", "cluster_size", "path", C("f.key").alias("key"), C("f.once").alias("once"), F.explode(F.array(*[F.struct(F.lit(n).alias("what"), C(f"f.{k}").alias("v")) for n, k in (("value", "v"), ("tooltip", "tu"), ("name", "t"))])).alias("x")).select("cluster_id", "cluster_size", "path", "key", "once", "x.*").where("key is not null")
    shown = F.concat(F.substring_index("path", "/", -1), F.lit(": "), F.coalesce(F.concat(F.lit("'"), C("v"), F.lit("'")), F.lit("None")))
    # null-safe: absent values and absent fields are one value, None
    keys = ["cluster_id", "key", "what"]
    one, two = (F.when(C("v").isNotNull(), h) for h in (F.xxhash64("v"), F.xxhash64(F.lit(1), C("v"))))
    kinds = F.when(F.max(one).isNull(), 0).when((F.min(one) == F.max(one)) & (F.min(two) == F.max(two)), 1).otherwise(2)
    agg = rows.groupBy(*keys).agg(F.first("cluster_size").alias("size"), F.count_if("once").alias("have"), kinds.alias("kinds"), F.max(~C("once") & C("v").isNull()).alias("gap"))
    agg = agg.where((C("kinds") + (C("gap") | (C("have") < C("size"))).cast("int")) > 1)
    first = least(rows.where("not once").select(*keys, shown.alias("v")), keys).distinct().withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("v"))).where(C("r") <= SHOWN)
    seen = first.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("v")), ", ").alias("seen"))
    agg = agg.join(seen, keys, "left").withColumn("seen", F.coalesce("seen", F.lit("")))
    text = F.concat(F.lit("field '"), C("key"), F.lit("' "), C("what"), F.lit(" differs ("), C("seen"), F.when(C("have") > SHOWN, F.concat(F.lit(", of "), C("have").cast("string"), F.lit(" files"))).otherwise(""), F.when(C("have") < C("size"), ", others: None").otherwise(""), F.lit(")"))
    return agg.groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_list(text)), "; ").alias("evidence")).select("cluster_id", F.lit("pdf_form_field").alias("field"), F.lit("form fields are filled in otherwise").alias("description"), "evidence")


def normalized(files: DataFrame, source: str | None = None) -> DataFrame:
    """(path, body, core, error): PDF objects in a canonical form without ids and dates of the file's making, and core.xml of ZIP
    documents. A file that cannot be read has neither, and says why, so that it differs from none."""

    def run(batches):
        import re

        for batch in batches:
            out = []
            for path, bucket, raw in rows_of(batch):
                body = core = error = None
                try:
                    raw = opened(raw, source, path)
                    if raw is None:
                        error = "content was not read"
                    elif bucket == "pdf":
                        body = "\n".join(sorted(re.sub(r"\s+", " ", x).strip() for k, x in pdf_objects(raw if isinstance(raw, bytes) else raw.read()) if k != "trailer"))
                    else:
                        made = list(zip_parts(raw, path))
                        core = next((t for k, n, t, _ in made if k == "zip_member" and n == "docProps/core.xml"), "")
                        error = next((t for k, _, t, _ in made if k == "error"), None)
                except Exception as e:  # noqa: BLE001 one bad file must not end the stage
                    error = str(e) or type(e).__name__
                out.append((path, body, core, error))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*out, strict=True) if out else ((), (), (), ()))], names=["path", "body", "core", "error"])

    return bounded(files.select("path", "bucket", "content")).mapInArrow(run, "path string, body string, core string, error string")


def body_diffs(members: DataFrame) -> DataFrame:
    h = F.sha2("body", 256)
    agg = members.where("body is not null").groupBy("cluster_id").agg((F.min(h) != F.max(h)).alias("differ")).where("differ")
    return agg.select("cluster_id", F.lit("pdf_normalized_bytes").alias("field"), F.lit("the documents' objects are not the same").alias("description"), F.lit("objects compared without ids and order").alias("evidence"))


def emit(members: DataFrame, diffs: DataFrame) -> DataFrame:
    """A finding for every difference and every member."""
    d = diffs.withColumnRenamed("cluster_id", "_c")
    rows = members.select("path", "sha256", "bucket", "extension", "cluster_id", "cluster_size").join(d, C("cluster_id") == C("_c"))
    row = hit("unique_fingerprint", C("field"), F.concat(F.lit("like files differ in "), C("field"), F.lit(": "), C("description")), C("evidence"), "docsignal", "medium", 0.8, F.create_map(F.lit("cluster_id"), C("cluster_id"), F.lit("cluster_size"), C("cluster_size").cast("string")))
    kind = F.when(C("extension") != "", C("extension")).otherwise(C("bucket"))
    order = place(5, F.lit(0), F.pmod(F.xxhash64("field"), F.lit(1000)))
    return rows.select(C("path").alias("file"), "sha256", kind.alias("file_type"), "bucket", F.lit(STAGE).alias("stage"), row.cast(HIT).alias("h"), order.alias("seq")).select("file", "sha256", "file_type", "bucket", "stage", "h.*", "seq")


#: buckets of which contents are compared
BUCKETS = ("pdf", "rtf", "ole", "ooxml", "odf", "image")


def contents(files: DataFrame, wanted: DataFrame, source: str | None) -> DataFrame:
    """(path, bucket, content) of the files with a path in `wanted`: from their column, or read again at `source`."""
    rows = files.join(wanted.select(C("path").alias("_w")).distinct(), C("path") == C("_w"), "left_semi")
    return (rows if "content" in files.columns else with_content(rows.select("path", "bucket", "size"), source)).select("path", "bucket", "content")


def uniqueness(files: DataFrame, metadata: DataFrame, fuzzy: bool = False, least: int = MIN_CLUSTER, compat: bool = False, source: str | None = None) -> DataFrame:
    """Findings of the differences within clusters, by bucket; a member that cannot be read gives an info row.

    files with a column `content`, or records without, which are then opened at `source`: only those in clusters.
    """
    members = clusters(files.drop("content"), metadata, fuzzy, least)
    of = lambda *b: members.where(C("bucket").isin(*b))
    body = lambda m: contents(files, m, source).select(C("path").alias("_f"), "content")
    texts = of("rtf", "ole").join(body(of("rtf", "ole")), C("path") == C("_f"))
    forms = normalized(contents(files, of("pdf", "ooxml", "odf"), source), source).withColumnRenamed("path", "_f")
    zipped, pdfs = of("ooxml", "odf").join(forms, C("path") == C("_f")), of("pdf").join(forms, C("path") == C("_f"))
    two = first_two(of("image"))
    held = body(two.select(C("a").alias("path")).union(two.select("b")))
    pairs = two.join(held.toDF("_a", "left"), C("a") == C("_a")).join(held.toDF("_b", "right"), C("b") == C("_b"))
    diffs = text_diffs(texts, text_of(C("content"), MAX_TEXT)).unionByName(core_diffs(zipped, C("core"), compat)).unionByName(body_diffs(pdfs)).unionByName(field_diffs(of("pdf"))).unionByName(size_diffs(of("image"))).unionByName(pixel_diffs(pairs))
    diffs = diffs.unionByName(tag_diffs(members.where(~C("bucket").isin(*BUCKETS))))
    why = F.coalesce(C("error"), F.lit("content was not read"))
    lost = zipped.unionByName(pdfs).where("error is not null").select("path", "sha256", "bucket", "extension", why.alias("why"))
    lost = lost.unionByName(texts.where("content is null").withColumn("error", F.lit(None).cast("string")).select("path", "sha256", "bucket", "extension", why.alias("why")))
    unread = findings(lost, STAGE, 5, F.array(info(STAGE, F.concat(F.lit("could not be compared: "), C("why")))))
    return emit(members, diffs).unionByName(unread)

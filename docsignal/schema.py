"""Row types of the engine and builders of finding rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INVENTORY = "path string, sha256 string, size long, mtime timestamp, mime string, bucket string, extension string"
FINDING = "file string, sha256 string, file_type string, bucket string, stage string, category string, subcategory string, finding string, evidence string, tool string, severity string, confidence double, extras map<string,string>"
METADATA = "path string, tags map<string,string>, form_fields array<struct<obj:string,ft:string,t:string,tu:string,v:string>>, error string"
HIT = "struct<category:string,subcategory:string,finding:string,evidence:string,tool:string,severity:string,confidence:double,extras:map<string,string>>"
COLUMNS = ["file", "sha256", "file_type", "bucket", "stage", "category", "subcategory", "finding", "evidence", "tool", "severity", "confidence", "extras"]
#: order in which rows are made: stage, file, part of the file, place within the part
SEQ = "struct<stage:int,file:string,part:long,pos:int>"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def hit(category, subcategory, finding, evidence, tool, severity, confidence, extras: Column | None = None) -> Column:
    """One detector hit; strings and numbers are literals."""
    parts = [("category", category), ("subcategory", subcategory), ("finding", finding), ("evidence", evidence), ("tool", tool), ("severity", severity)]
    made = F.struct(*[_c(v).cast("string").alias(k) for k, v in parts], _c(confidence).cast("double").alias("confidence"), (extras if extras is not None else F.create_map()).cast("map<string,string>").alias("extras"))
    return made.cast(HIT)


def none() -> Column:
    return F.array().cast(f"array<{HIT}>")


def when(condition: Column, one: Column) -> Column:
    """An array of the hit if the condition holds, else empty."""
    return F.when(condition, F.array(one)).otherwise(none())


def findings(files: DataFrame, stage: str, stage_no: int, hits: Column) -> DataFrame:
    """A finding row for each hit of each file row (path, sha256, bucket, extension), with its place in `seq`."""
    rows = files.select("path", "sha256", "bucket", "extension", F.posexplode(hits).alias("pos", "h"))
    kind = F.when(F.col("extension") != "", F.col("extension")).otherwise(F.col("bucket"))
    return rows.select(F.col("path").alias("file"), "sha256", kind.alias("file_type"), "bucket", F.lit(stage).alias("stage"), "h.*", place(stage_no, F.lit(0), F.col("pos")).alias("seq"))


def place(stage_no: int, part: Column, pos: Column) -> Column:
    """`seq` of a row made from the file `path`."""
    return F.struct(F.lit(stage_no).alias("stage"), F.col("path").alias("file"), part.cast("long").alias("part"), pos.cast("int").alias("pos")).cast(SEQ)


def info(stage: str, message: Column | str) -> Column:
    """The row of a file that could not be examined."""
    return hit("no_bucket_check", "", message, "", "docsignal", "info", 0.0)

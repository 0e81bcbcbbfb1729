"""Incremental scans: new files are detected once, calibration runs over all findings so far.

Detectors hold no state, so a stream of file rows goes through the same expressions. How rare a domain is depends on all files, and
a later file can lower an earlier finding, so calibration reads the findings table instead of keeping state in the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect
from ..operators.report import report
from ..sources.files import classify


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """File rows of new files under a folder. The built-in source leaves out names that begin with a dot or underscore."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(path)
    return classify(raw.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content"))


def detect_new(spark: SparkSession, path: str, out: str, checkpoint: str, specialized: bool = False):
    """Detect what is new since the last call and append it to the findings table `out`; returns the ended query."""

    def batch(df: DataFrame, epoch: int) -> None:
        found = detect.inventory_findings(df).unionByName(detect.remote_references(df, specialized=specialized)).unionByName(detect.embedded(df)).unionByName(detect.stego(df))
        # a repeated epoch overwrites its own folder, so each batch counts once
        found.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    q = stream_files(spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def current_report(spark: SparkSession, out: str, **rules) -> DataFrame:
    """Report over all findings so far."""
    return report(spark, [spark.read.parquet(out).drop("epoch")], **rules)


def link_counts(events: DataFrame, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(window, domain, n): link findings by time window and domain, from a stream of (ts, domain), late rows dropped after `delay`."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "domain").agg(F.count("*").alias("n"))

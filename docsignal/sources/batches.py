"""Arrow batches of file contents: bounded by bytes on their way to a Python worker, and turned into Python objects a row at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: bytes that a batch holds about; a larger row is a batch of its own
BATCH = 2 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(rows: DataFrame) -> DataFrame:
    """The table, of which mapInArrow is sent batches of about BATCH bytes; the setting stays for the session."""
    spark = rows.sparkSession
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_LIMIT))
    if not 0 < now <= BATCH:
        spark.conf.set(_LIMIT, str(BATCH))
    return rows


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows as Python objects, one at a time, so that a batch's contents are not held twice."""
    for k in range(batch.num_rows):
        yield tuple(c[k].as_py() for c in batch.columns)

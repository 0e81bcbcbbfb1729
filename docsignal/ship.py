"""Makes the package importable in Python workers that do not share the driver's path."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers once an application, unless they inherit a path on which it lies."""
    sc = spark.sparkContext
    if sc.applicationId in _DONE:
        return
    _DONE.add(sc.applicationId)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    inherited = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in inherited or (os.path.abspath(os.getcwd()) == root and sc.master.startswith("local[")):
        return
    folder = tempfile.mkdtemp(prefix="docsignal-")
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "docsignal"), "zip", root, "docsignal"))

"""Sends this package to the executors, which needn't find it by themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's files, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _done:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "sealwright.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(_ROOT, "sealwright")):
            for n in names:
                if n.endswith((".py", ".json")):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, _ROOT))
    spark.sparkContext.addPyFile(path)
    _done.add(app)

"""Sends this package to the executors' Python, once per application."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip to the application's Python files, so that tasks can import it wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-evidlake-code-"), "evidlake.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, n)
                z.write(full, os.path.join("evidlake", os.path.relpath(full, root)))
    context.addPyFile(path)
    _SENT.add(context.applicationId)

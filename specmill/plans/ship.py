"""Sends the package to the executors, where it may not be installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package's sources to the application, once."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    root = Path(__file__).resolve().parent.parent
    handle, path = tempfile.mkstemp(prefix=f"{root.name}_", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(path)
    _SENT.add(context.applicationId)

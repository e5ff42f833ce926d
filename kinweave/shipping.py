"""Sends this package to the Python workers."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: list[str] = []


def ship(spark: SparkSession) -> SparkSession:
    """Once for each application; code that runs in Python workers needs it."""
    context = spark.sparkContext
    if _shipped != [context.applicationId]:
        root = Path(__file__).resolve().parent
        with tempfile.NamedTemporaryFile(prefix="kinweave", suffix=".zip", delete=False) as out, zipfile.ZipFile(out, "w") as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, path.relative_to(root.parent))
        context.addPyFile(out.name)
        atexit.register(lambda: os.path.exists(out.name) and os.unlink(out.name))
        _shipped[:] = [context.applicationId]
    return spark

"""Makes the package importable in the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's files to the executors, once per application; Spark's file server delivers them."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    if root.is_dir():  # inside a zip it was shipped already
        folder = tempfile.mkdtemp(prefix="traceloom-ship-")
        path = os.path.join(folder, "traceloom.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, str(Path(root.name) / f.relative_to(root)))
        context.addPyFile(path)
    _SHIPPED.add(context.applicationId)

"""Sends this package to the Python workers, so a cluster needs no install and no shared folder for code."""

from __future__ import annotations

import atexit
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Once per context; Spark's own file server hands the archive to every executor."""
    context = spark.sparkContext
    if getattr(context, "_newsflow_shipped", False):
        return
    context._newsflow_shipped = True
    top = Path(__file__).resolve().parent
    holder = tempfile.TemporaryDirectory(prefix="newsflow-code-")
    atexit.register(holder.cleanup)
    archive = Path(holder.name, "newsflow.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(str(archive))

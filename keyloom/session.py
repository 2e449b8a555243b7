"""Making the package known to a session's executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once for each context.

    Needless where it is installed on all executors; harmless there.
    """
    context = spark.sparkContext
    if getattr(context, "_keyloom_shipped", False):
        return
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="keyloom-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/keyloom.zip", "w") as out:
        for p in sorted(top.rglob("*.py")):
            out.write(p, p.relative_to(top.parent))
    context.addPyFile(f"{folder}/keyloom.zip")
    context._keyloom_shipped = True

"""The package on the executors, for tasks that run its Python code."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors of this application the package, once."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    if package.is_dir():  # else it runs from a shipped archive already
        archive = Path(tempfile.mkdtemp(prefix="linkrec-")) / "linkrec.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)

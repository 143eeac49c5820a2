"""Sends this package to the executors, whose Python workers import it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the session's Python files, once; not where it is itself in an archive."""
    context = spark.sparkContext
    if context.applicationId in _sent or not PACKAGE.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="basaltine-")) / "basaltine.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(PACKAGE.rglob("*.py")):
            z.write(source, source.relative_to(PACKAGE.parent))
    context.addPyFile(str(archive))
    _sent.add(context.applicationId)

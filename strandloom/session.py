"""Making this package importable on every executor."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application, so that Python workers can import it from any folder."""
    context = spark.sparkContext
    if getattr(context, "_strandloom_shipped", False):
        return
    root = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="strandloom-")) / "strandloom.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, Path("strandloom") / file.relative_to(root))
    context.addPyFile(str(path))
    context._strandloom_shipped = True

"""Sends this package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once for each Spark context; Spark serves the archive to executors that come later as well."""
    sc = spark.sparkContext
    if getattr(sc, "_dialoom_shipped", False):
        return
    top = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="dialoom-")).resolve() / "dialoom_package.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    sc.addPyFile(str(at))
    sc._dialoom_shipped = True

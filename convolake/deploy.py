"""Gives the package to the executors, so that their Python workers can import it wherever the driver was started."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_given: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the application once; Spark serves the file to executors, also to those that come later."""
    app = spark.sparkContext.applicationId
    if app in _given:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="convolake-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _given.add(app)

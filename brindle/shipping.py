"""The package's own sources for the executors, whose Python may not have it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application; Spark serves the file to them."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent
    if getattr(sc, "_brindle_shipped", False) or not root.is_dir():
        return
    path = os.path.join(tempfile.mkdtemp(prefix="brindle-"), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    sc.addPyFile(path)
    sc._brindle_shipped = True

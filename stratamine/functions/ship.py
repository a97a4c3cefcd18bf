"""Sends the package to the executors, which need not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once per Spark context: a zip of the modules, served to executors by the driver, new ones included."""
    sc = spark.sparkContext
    if getattr(sc, "_stratamine_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(), "stratamine.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path("stratamine", p.relative_to(root))))
    sc.addPyFile(path)
    sc._stratamine_shipped = True

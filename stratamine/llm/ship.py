"""Sends the package to the executors, which need not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Once per Spark context: a zip of the modules, served to executors by the driver, new ones included.

    Checkpoints go to the folder in spark.checkpoint.dir. Where none is set, a single machine gets one of our own; on a
    cluster executors could not share that, so it is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir names no shared folder")
        sc.setCheckpointDir(folder or tempfile.mkdtemp())
    if getattr(sc, "_stratamine_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(), "stratamine.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path("stratamine", p.relative_to(root))))
    sc.addPyFile(path)
    sc._stratamine_shipped = True


def settled(df: DataFrame) -> DataFrame:
    """The checkpoint of df. What was shuffled for it leaves the executors' disks at once, for nothing reads it again.

    A frame takes the setting over when it is made; one that another thread makes meanwhile loses its own shuffles once
    it has run, and computes them anew if it runs again.
    """
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        conf.set(name, before)

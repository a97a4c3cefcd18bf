"""Cuts the lineage of iterative plans through the checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir. Where none is set, a single machine gets one of our own, as in tests; on
    a cluster executors could not share that, so it is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir names no shared folder")
        sc.setCheckpointDir(named or tempfile.mkdtemp())
    return sc._jsc.sc().getCheckpointDir().get()


def dealt(df: DataFrame, parts: int | None, *by: str) -> DataFrame:
    """df by hash of columns in so many partitions, which joins and groups by them keep; without a number as it is."""
    return df.repartition(parts, *by) if parts else df


def settle(df: DataFrame) -> DataFrame:
    """Computes df once and goes on from its checkpoint, which survives lost executors."""
    folder(df.sparkSession)
    return df.checkpoint()

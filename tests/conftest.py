import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [sys.path[0], os.environ.get("PYTHONPATH", "")]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, an empty, a white, a very long and a repeated text, repeated ids, and columns with clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, long), (5, "the same text twice, you see"), (6, "the same text twice, you see"), (7, "É"), (7, "É"), (None, "no id here"), (None, None), (8, "12345 !!! 678"), (9, "a" * 5000), (10, "don't  stop   now\n\n'tis <|endoftext|> 日本語の文章 ٣٤٥")]
    return spark.createDataFrame([(i, t, None, None, None, 1, "x", 2.0, "y") for i, t in rows], DOCS + ", score int, spans string, block double, codes string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)

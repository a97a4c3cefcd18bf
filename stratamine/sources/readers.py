"""Readers. All take a path that Spark can read and a fixed schema, so that columns are pruned at the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REVIEW = "review_id string, user_id string, business_id string, stars double, text string, date string"
BUSINESS = "business_id string, categories string, state string, city string"
TWEET = "entities struct<hashtags: array<struct<text: string>>>"
ITEM_MODEL = "b1 string, b2 string, sim double"
USER_MODEL = "u1 string, u2 string, sim double"
PAIRS = "user_id string, business_id string"


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """One JSON object a line. Strict: a malformed line raises; else it gives nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def csv_table(spark: SparkSession, path: str, schema: str | T.StructType, header: bool = True) -> DataFrame:
    """Comma-separated rows; the header line is skipped. A file with only a header gives no rows."""
    return spark.read.schema(schema).csv(path, header=header)


def vectors_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Lines of an id and numbers, without a header: id and x (array of double). The last of repeated ids isn't
    defined by a set of files, so all rows are kept."""
    parts = F.split("value", sep)
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(parts[0].alias("id"), F.slice(parts, 2, F.size(parts) - 1).cast("array<double>").alias("x"))


def chunks(spark: SparkSession, path: str, sep: str = ",") -> list[DataFrame]:
    """The vector files of a folder as one DataFrame each, in the order of their names."""
    files = spark.read.format("binaryFile").load(path).select("path").orderBy("path").collect()  # one row a file
    return [vectors_csv(spark, r["path"], sep) for r in files]


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """A word a line, stripped, as ``word``; empty lines give none."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def two_section_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The text model of four lines (a label, an object of lists, a label, an object of lists) as (id, items) twice."""
    text = spark.read.text(path, wholetext=True)
    lines = F.split(F.rtrim("value"), "\n")
    kind = "map<string,array<string>>"
    return tuple(text.select(F.explode(F.from_json(lines[i], kind)).alias("id", "items")) for i in (1, 3))


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """A stream of text lines from a TCP socket, as ``value``."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def file_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files at a path, so many for each trigger. A stream's source is a folder, so a single
    file is read through a filter on its folder."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(there).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", there.getName()).parquet(there.getParent().toString())


def local_rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """Rows of the driver as a DataFrame."""
    return spark.createDataFrame(rows, schema)

"""Windowed operators over an event stream (ts, key ...). Event time, in UTC, with a watermark.

Each keeps only grouped state in the stream (words, distinct keys or the highest zeros by window) and writes it in
complete mode to a folder in the shared checkpoint folder; a second, small aggregation reads that. A stream can't
count distinct values or rank, so this is how both are done.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamine.functions.hashing import family_array, linear, trailing_zeros
from stratamine.functions.settle import folder


def instant(ts: str) -> Column:
    """A timestamp without time zone as the instant in UTC, whatever the session's zone."""
    return F.expr(f"timestamp_seconds(0) + (cast({ts} as timestamp_ntz) - timestamp_ntz'1970-01-01 00:00:00')")


def epoch(ts: str | Column) -> Column:
    return F.unix_timestamp(ts).cast("bigint")


def run_complete(grouped: DataFrame) -> DataFrame:
    """Runs an aggregated stream over all that is there now; its state as a table."""
    spark = grouped.sparkSession
    path = f"{folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(df: DataFrame, _: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/state")

    query = grouped.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(grouped.schema).parquet(f"{path}/state")


def windowed(stream: DataFrame, ts: str, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Adds window_start (seconds since 1970)."""
    with_time = stream.withColumn("_t", instant(ts)).withWatermark("_t", late)
    return with_time.withColumn("_w", F.window("_t", length, slide) if slide else F.window("_t", length)).withColumn("window_start", epoch("_w.start"))


def word_count(stream: DataFrame, ts: str, text: Column, length: str = "1 hour") -> DataFrame:
    """window_start, word, n."""
    rows = windowed(stream.withColumn("_text", text), ts, length).select("_w", F.explode(F.split("_text", " ")).alias("word")).where("word <> ''")
    return run_complete(rows.groupBy("_w", "word").agg(F.count("*").alias("n"))).select(epoch("_w.start").alias("window_start"), "word", "n")


def sliding_distinct(stream: DataFrame, ts: str, key: str, length: str, slide: str) -> DataFrame:
    """window_start, n_distinct: exact."""
    rows = windowed(stream.where(F.col(key).isNotNull()), ts, length, slide)
    state = run_complete(rows.groupBy("_w", key).agg(F.count("*").alias("n")))
    return state.groupBy(epoch("_w.start").alias("window_start")).agg(F.count("*").alias("n_distinct"))


def sliding_flajolet_martin(stream: DataFrame, ts: str, number: Column, hashes: list[tuple[int, int, int]], modulus: int, groups: int, each: int, length: str, slide: str) -> DataFrame:
    """window_start, estimate of distinct numbers."""
    from stratamine.operators.sketch import flajolet_martin

    rows = windowed(stream.withColumn("_x", number), ts, length, slide).select("_w", "_x", F.explode(family_array(hashes)).alias("h"))
    zeros = rows.select("_w", F.col("h.i").alias("i"), trailing_zeros(linear(F.col("_x"), F.col("h.a"), F.col("h.b"), modulus)).alias("r"))
    state = run_complete(zeros.groupBy("_w", "i").agg(F.max("r").alias("r"))).select(epoch("_w.start").alias("window_start"), "i", "r")
    return flajolet_martin(state, groups, each, "window_start")


def console(df: DataFrame) -> None:
    """Shows a stream's batches on the console until it is stopped."""
    df.writeStream.outputMode("complete").format("console").start().awaitTermination()


def append_csv(df: DataFrame, path: str, log: str):
    """Starts a query that appends each batch's rows to CSV files with a header."""
    return df.writeStream.outputMode("append").format("csv").option("header", True).option("checkpointLocation", log).start(path)


def append_text(df: DataFrame, line: Column, path: str, log: str):
    """Starts a query that appends a line of text for each row of each batch."""
    return df.select(line.alias("value")).writeStream.outputMode("append").format("text").option("checkpointLocation", log).start(path)


def events(spark: SparkSession, path: str) -> DataFrame:
    from stratamine.sources.readers import file_stream

    return file_stream(spark, path)

"""Readers and writers: what is written to the shared folder and read again equals its table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamine.functions.settle import folder
from stratamine.plans.registry import R, query, reviews, table
from stratamine.sources import readers, writers


def _path(spark: SparkSession) -> str:
    return f"{folder(spark)}/round-trip-{uuid.uuid4().hex}"


@query(f"SELECT CAST(u AS VARCHAR) AS user_id, CAST(b AS VARCHAR) AS business_id, s AS stars, strftime(d, '%Y-%m-%d') AS date FROM {R}")
def review_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews as lines of JSON, read with the schema of reviews."""
    path = _path(spark)
    rows = reviews(spark, sf_dir).select(F.col("u").cast("string").alias("user_id"), F.col("b").cast("string").alias("business_id"), F.col("s").cast("double").alias("stars"), F.date_format("d", "yyyy-MM-dd").alias("date"))
    writers.json_lines(rows, path)
    return readers.json_lines(spark, path, readers.REVIEW).select("user_id", "business_id", "stars", "date")


@query(f"SELECT DISTINCT CAST(u AS VARCHAR) AS user_id, CAST(b AS VARCHAR) AS business_id FROM {R}")
def pair_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and businesses as CSV with a header."""
    path = _path(spark)
    writers.csv_table(reviews(spark, sf_dir).select(F.col("u").cast("string").alias("user_id"), F.col("b").cast("string").alias("business_id")).distinct(), path)
    return readers.csv_table(spark, path, readers.PAIRS)


@query("SELECT CAST(vec_id AS VARCHAR) AS id, len(embedding) AS n, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings")
def vector_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as lines of an id and numbers, without a header."""
    path = _path(spark)
    rows = table(spark, sf_dir, "embeddings").select(F.concat_ws(",", F.col("vec_id").cast("string"), F.transform("embedding", lambda v: v.cast("double").cast("string"))).alias("value"))
    rows.write.text(path)
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return readers.vectors_csv(spark, path).select("id", F.size("x").cast("long").alias("n"), F.round(total, 4).alias("total"))


@query("SELECT DISTINCT trim(part) AS word FROM (SELECT unnest(string_split(p_name, ' ')) AS part FROM part) WHERE trim(part) <> ''")
def word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of words, one a line."""
    path = _path(spark)
    table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("value")).write.text(path)
    return readers.word_list(spark, path)


@query("SELECT p_partkey AS b1, p_size AS b2, p_size / 64 AS sim FROM part")
def model_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs and similarities as lines of JSON, the form of a recommender's model."""
    path = _path(spark)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("b1"), F.col("p_size").cast("string").alias("b2"), (F.col("p_size") / 64).alias("sim"))
    writers.json_lines(rows, path)
    return readers.json_lines(spark, path, readers.ITEM_MODEL).select(F.col("b1").cast("long").alias("b1"), F.col("b2").cast("int").alias("b2"), "sim")

"""The list of queries."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamine.functions.settle import dealt

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a partition, beyond which there are more partitions than the session asks for.
SHARE = 500_000


def parts(spark: SparkSession, sf_dir: str) -> int | None:
    """How many partitions line items need, so that the memory of a task doesn't grow with them; None if the session's
    number will do. The count comes from the files' footers."""
    n = ceil(table(spark, sf_dir, "lineitem").count() / SHARE)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as reviews: u (customer), b (part), s (quantity), d (date)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    n = parts(spark, sf_dir)
    return dealt(lines, n, "l_orderkey").join(dealt(orders, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("u"), F.col("l_partkey").alias("b"), F.col("l_quantity").alias("s"), F.col("o_orderdate").alias("d"))


R = "(SELECT o_custkey AS u, l_partkey AS b, l_quantity AS s, o_orderdate AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
RA = f"(SELECT u, b, avg(s) AS s, count(*) AS reviews FROM {R} GROUP BY u, b)"

"""Data exploration: counts, top lists, averages by category, partition profiles, indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamine.functions.settle import settle
from stratamine.functions.text import is_stopword, plain_words


def review_counts(reviews: DataFrame, year: int, user: str, date: str, counted: Column | None = None) -> DataFrame:
    """total, in_year and users (distinct, of rows where ``counted``) in one pass."""
    return reviews.agg(F.count("*").alias("total"), F.count_if(F.year(date) == year).alias("in_year"), F.countDistinct(F.when(F.lit(True) if counted is None else counted, F.col(user))).alias("users"))


def top_keys(df: DataFrame, key: str, m: int) -> DataFrame:
    """The m keys with most rows, equal ones by key: key and n."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(m)


def top_words(df: DataFrame, text: str, n: int) -> DataFrame:
    """The n most frequent words that aren't stop words, equal ones by word. Null texts have none."""
    words = df.select(F.explode(plain_words(F.col(text))).alias("word")).where((F.col("word") != "") & ~is_stopword(F.col("word")))
    return top_keys(words, "word", n)


def category_average(reviews: DataFrame, business: DataFrame, key: str, stars: str, names: str, n: int, keep_empty: bool = False) -> DataFrame:
    """The n categories with the highest average of stars over all reviews of their businesses, equal ones by name.

    Reviews are summed by business before the join, so only one row a business is shuffled on. ``names`` is an array
    column of business. keep_empty: categories without reviews count as 0.
    """
    sums = reviews.groupBy(key).agg(F.sum(stars).alias("s"), F.count(stars).alias("c"))
    rows = business.select(key, names).join(sums, key, "left" if keep_empty else "inner").select(F.explode(names).alias("category"), "s", "c")
    mean = F.round(F.coalesce(F.sum("s") / F.nullif(F.sum("c"), F.lit(0)), F.lit(0.0)), 6)
    return rows.groupBy("category").agg(mean.alias("avg_stars")).orderBy(F.desc("avg_stars"), "category").limit(n)


def more_than(df: DataFrame, key: str, n: int) -> DataFrame:
    """Keys with more than n rows."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > n)


def by_first_character(key: str | Column, n: int) -> Column:
    """The partition number of a key by its first character."""
    c = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.ascii(F.substring(c.cast("string"), 1, 1)), F.lit(n)).cast("int")


def deal(df: DataFrame, number: Column, n: int) -> DataFrame:
    """Rows dealt to exactly n partitions by a partition number."""
    return df.repartitionById(n, number)


def partition_profile(df: DataFrame, number: Column, n: int) -> DataFrame:
    """part (0 to n - 1) and its rows, empty parts too."""
    counts = df.groupBy(number.alias("part")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias("part")).join(counts, "part", "left").select("part", F.coalesce("n", F.lit(0)).alias("n_items"))


def current_profile(df: DataFrame) -> DataFrame:
    """part and its rows as df is dealt now."""
    n = df.rdd.getNumPartitions()
    return partition_profile(df.withColumn("_p", F.spark_partition_id()), F.col("_p"), n)


def dense_index(df: DataFrame, key: str) -> DataFrame:
    """Each distinct key with its number (from 0) in the order of keys. Keys are sorted by ranges; a range adds the
    sizes of those before it, so no task sees more than its range."""
    rows = settle(df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).withColumn("_m", F.monotonically_increasing_id()))
    rows = rows.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(F.lit(2**33 - 1)))
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_n"))  # one row a partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    return rows.join(before, "_p").select(key, (F.col("_i") + F.col("_before")).alias("idx"))

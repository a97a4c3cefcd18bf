"""Sketches: Bloom filters, Flajolet-Martin counts, samples and most frequent items of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamine.functions.hashing import family_array, hash60, linear, trailing_zeros


def bloom_positions(keys: DataFrame, key: str, hashes: list[tuple[int, int, int]], bits: int) -> DataFrame:
    """The bits that the distinct keys set, as ``position``: at most ``bits`` rows, whatever the input."""
    rows = keys.where(F.col(key).isNotNull()).select(key).distinct().select(hash60(key).alias("x"), F.explode(family_array(hashes)).alias("h"))
    return rows.select(linear(F.col("x"), F.col("h.a"), F.col("h.b"), bits).alias("position")).distinct()


def bloom_probe(rows: DataFrame, key: str, positions: DataFrame, hashes: list[tuple[int, int, int]], bits: int) -> DataFrame:
    """key and seen (1 or 0) of each distinct key. The filter has at most ``bits`` rows, so it is broadcast; a null key
    was not seen."""
    keys = rows.select(key).distinct()
    probes = keys.select(key, F.explode(family_array(hashes)).alias("h")).select(key, linear(hash60(key), F.col("h.a"), F.col("h.b"), bits).alias("position"))
    marked = probes.join(F.broadcast(positions.withColumn("hit", F.lit(1))), "position", "left")
    return marked.groupBy(key).agg(F.when(F.count("hit") == len(hashes), 1).otherwise(0).alias("seen"))


def bloom_estimate(keys: DataFrame, key: str, hashes: int, bits: int) -> DataFrame:
    """keys, fill (hashes * keys / bits) and the expected share of false positives."""
    m = F.countDistinct(key)
    return keys.agg(m.alias("keys"), F.round(m * hashes / F.lit(bits), 6).alias("fill"), F.round(F.pow(1 - F.exp(-hashes * m / F.lit(bits)), F.lit(hashes)), 6).alias("error"))


def hashed_zeros(rows: DataFrame, key: Column, hashes: list[tuple[int, int, int]], modulus: int, *by: str) -> DataFrame:
    """The most zeros at the end of each hash function's values, by group: by..., i, r."""
    hashed = rows.select(*by, key.alias("x"), F.explode(family_array(hashes)).alias("h"))
    return hashed.select(*by, F.col("h.i").alias("i"), trailing_zeros(linear(F.col("x"), F.col("h.a"), F.col("h.b"), modulus)).alias("r")).groupBy(*by, "i").agg(F.max("r").alias("r"))


def flajolet_martin(zeros: DataFrame, groups: int, each: int, *by: str) -> DataFrame:
    """The estimate: in groups of hash functions the mean of 2^r, the median of these, rounded down."""
    means = zeros.where(F.col("i") < groups * each).groupBy(*by, F.floor(F.col("i") / each).cast("int").alias("g")).agg(F.avg(F.pow(F.lit(2.0), F.col("r"))).alias("mean"))
    return means.groupBy(*by).agg(F.floor(F.median("mean")).cast("bigint").alias("estimate"))


def sample(rows: DataFrame, key: str, size: int, seed: str = "s") -> DataFrame:
    """A uniform sample without replacement: the rows whose keys' hashes with the seed are the least. Each task keeps
    only its own least, so nothing is sorted whole."""
    return rows.withColumn("_h", hash60(F.concat(F.lit(seed), F.col(key).cast("string")))).orderBy("_h", key).limit(size).drop("_h")


def top_frequencies(rows: DataFrame, key: str, ranks: int = 3) -> DataFrame:
    """Keys whose frequency is among the highest distinct ones, ties kept: key, n, rank."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    best = counts.select("n").distinct().orderBy(F.desc("n")).limit(ranks)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"))))  # as many rows as ranks
    return counts.join(F.broadcast(ranked), "n").select(key, "n", "rank")

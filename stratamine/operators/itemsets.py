"""Frequent itemsets: baskets, level-wise mining, hash-bucket pruning, two-pass chunked mining, pattern growth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamine.functions.settle import settle
from stratamine.operators.growth import grown


def baskets(df: DataFrame, basket: str, item: str, more_than: int = 0) -> DataFrame:
    """basket and items (sorted distinct array), of baskets with more than so many items."""
    return df.groupBy(F.col(basket).alias("basket")).agg(F.sort_array(F.collect_set(item)).alias("items")).where(F.size("items") > more_than)


def entries(df: DataFrame, basket: str, item: str) -> DataFrame:
    """Distinct (basket, item)."""
    return df.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where(F.col("basket").isNotNull() & F.col("item").isNotNull()).distinct()


def frequent(rows: DataFrame, k: int, support: int, deal: int | None = None) -> DataFrame:
    """Itemsets of k items in at least ``support`` baskets: items (sorted array) and support.

    Level by level, where the baskets of an item are: rows of sets that are not frequent one level below go no further.
    """
    if k == 1:
        return rows.groupBy("item").agg(F.count("*").alias("support")).where(F.col("support") >= support).select(F.array("item").alias("items"), "support")
    return grown(rows, support, k, deal)


def bucket_of(a: Column, b: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(a, b), F.lit(buckets))


def frequent_pairs_by_buckets(rows: DataFrame, support: int, buckets: int = 4096) -> DataFrame:
    """Frequent pairs, counted only in hash buckets whose pairs together reach the support."""
    singles = rows.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    kept = rows.join(singles, "item", "left_semi")
    x, y = kept.alias("x"), kept.alias("y")
    pairs = x.join(y, (F.col("x.basket") == F.col("y.basket")) & (F.col("x.item") < F.col("y.item"))).select(F.col("x.item").alias("a"), F.col("y.item").alias("b"))
    pairs = pairs.withColumn("bucket", bucket_of(F.col("a"), F.col("b"), buckets))
    full = pairs.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("bucket")
    counts = pairs.join(full, "bucket", "left_semi").groupBy("a", "b").agg(F.count("*").alias("support"))
    return counts.where(F.col("support") >= support).select(F.array("a", "b").alias("items"), "support")


def chunk_candidates(rows: DataFrame, chunk: Column, support: int, k: int | None = None) -> DataFrame:
    """Itemsets that are frequent in some chunk, for the share of the support that falls to the chunk's baskets: items
    and chunks (how many have it). No set that is frequent in all is missing. Sets have up to k items; without k, levels
    go on until one has no set, each from the checkpoint of the one before."""
    rows = rows.withColumn("chunk", chunk)
    sizes = rows.groupBy("chunk").agg(F.countDistinct("basket").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    least = sizes.join(F.broadcast(total)).select("chunk", F.greatest(F.lit(1), F.floor(F.lit(support) * F.col("n") / F.col("total"))).alias("least"))  # one row of totals beside one row a chunk
    single = rows.groupBy("chunk", "item").agg(F.count("*").alias("c")).join(F.broadcast(least), "chunk").where(F.col("c") >= F.col("least")).select("chunk", "item")
    kept = rows.join(single, ["chunk", "item"], "left_semi")
    level, good = kept.select("chunk", "basket", F.array("item").alias("items")), single.select("chunk", F.array("item").alias("items"))
    out = [good]
    while k is None or len(out) < k:
        level = level.join(good, ["chunk", "items"], "left_semi").join(kept, ["chunk", "basket"]).where(F.col("item") > F.element_at("items", -1)).select("chunk", "basket", F.concat("items", F.array("item")).alias("items"))
        level = settle(level) if k is None else level
        good = level.groupBy("chunk", "items").agg(F.count("*").alias("c")).join(F.broadcast(least), "chunk").where(F.col("c") >= F.col("least")).select("chunk", "items")
        if k is None:
            good = settle(good)
            if good.isEmpty():
                break
        out.append(good)
    return reduce(DataFrame.unionByName, out).groupBy("items").agg(F.count("*").alias("chunks"))


def count_candidates(rows: DataFrame, candidates: DataFrame, support: int) -> DataFrame:
    """Candidates in at least ``support`` baskets: each member of a candidate meets its baskets, and a basket that
    meets all members contains it."""
    members = candidates.select("items", F.explode("items").alias("item"))
    hits = members.join(rows, "item").groupBy("items", "basket").agg(F.count("*").alias("n")).where(F.col("n") == F.size("items"))
    return hits.groupBy("items").agg(F.count("*").alias("support")).where(F.col("support") >= support)


def by_growth(rows: DataFrame, support: int, total: int | None = None, deal: int | None = None) -> DataFrame:
    """Frequent itemsets of every size by pattern growth: items (sorted array) and support. Rows are distinct (basket,
    item); the support is a number of baskets, so their total is not needed."""
    return grown(rows, support, deal=deal)

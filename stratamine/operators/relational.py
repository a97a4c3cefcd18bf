"""Joins and set operations as the mining tasks use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamine.functions.settle import dealt
from stratamine.operators.pairs import sharing


def semi(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    return left.join(right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    return left.join(right, on, "left_anti")


def both_ways(pairs: DataFrame, a: str, b: str, *carried: str) -> DataFrame:
    """Every pair in both orders."""
    return pairs.select(a, b, *carried).unionByName(pairs.select(F.col(b).alias(a), F.col(a).alias(b), *carried))


def merged_adjacency(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """id and others (sorted distinct array): the full outer join of both directions' lists."""
    one = pairs.groupBy(F.col(a).alias("id")).agg(F.collect_set(b).alias("x"))
    two = pairs.groupBy(F.col(b).alias("id")).agg(F.collect_set(a).alias("y"))
    none = F.array().cast(one.schema["x"].dataType)
    return one.join(two, "id", "full_outer").select("id", F.sort_array(F.array_union(F.coalesce("x", none), F.coalesce("y", none))).alias("others"))


def shared(df: DataFrame, key: str, member: str, at_least: int, deal: int | None = None) -> DataFrame:
    """Pairs k1 < k2 of keys with at least so many members in common, and their number (both). Rows are distinct (key,
    member); keys with too few members go first."""
    if at_least > 1:
        df = dealt(df, deal, key)
        df = semi(df, df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= at_least).select(key), key)
    return sharing(df, key, member, at_least, deal=deal)


def contains_all(array: str | Column, of: str | Column) -> Column:
    """Whether every member of ``of`` is in ``array``."""
    return F.size(F.array_except(of, array)) == 0

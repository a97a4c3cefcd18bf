"""Baskets of suppliers by order, and their frequent sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamine.functions.settle import dealt
from stratamine.operators import itemsets
from stratamine.plans.registry import parts, query, table

SUPPORT, TRIPLES, CHUNKS = 30, 5, 3
E = "(SELECT DISTINCT l_orderkey AS basket, l_suppkey AS item FROM lineitem)"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return itemsets.entries(dealt(lines, parts(spark, sf_dir), "l_orderkey", "l_suppkey"), "l_orderkey", "l_suppkey")


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("items", F.array_join(F.transform("items", lambda x: x.cast("string")), ","))


@query(f"SELECT basket, string_agg(CAST(item AS VARCHAR), ',' ORDER BY item) AS items FROM {E} GROUP BY basket")
def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(itemsets.baskets(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey"))


@query(f"SELECT basket, string_agg(CAST(item AS VARCHAR), ',' ORDER BY item) AS items FROM {E} GROUP BY basket HAVING count(*) > 5")
def baskets_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(itemsets.baskets(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", 5))


SINGLES = f"SELECT CAST(item AS VARCHAR) AS items, count(*) AS support FROM {E} GROUP BY item HAVING count(*) >= {{0}}"
PAIRS = f"SELECT x.item || ',' || y.item AS items, count(*) AS support FROM {E} x JOIN {E} y ON x.basket = y.basket AND x.item < y.item GROUP BY x.item, y.item HAVING count(*) >= {{0}}"
THREES = f"SELECT x.item || ',' || y.item || ',' || z.item AS items, count(*) AS support FROM {E} x JOIN {E} y ON x.basket = y.basket AND x.item < y.item JOIN {E} z ON z.basket = y.basket AND y.item < z.item GROUP BY x.item, y.item, z.item HAVING count(*) >= {{0}}"


@query(SINGLES.format(SUPPORT))
def frequent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(itemsets.frequent(_rows(spark, sf_dir), 1, SUPPORT))


@query(PAIRS.format(SUPPORT))
def frequent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(itemsets.frequent(_rows(spark, sf_dir), 2, SUPPORT, parts(spark, sf_dir)))


@query(THREES.format(TRIPLES))
def frequent_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(itemsets.frequent(_rows(spark, sf_dir), 3, TRIPLES, parts(spark, sf_dir)))


@query(PAIRS.format(SUPPORT))
def pcy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(itemsets.frequent_pairs_by_buckets(_rows(spark, sf_dir), SUPPORT))


#: Every subset of every basket, with its largest item.
SUBSETS = "e AS MATERIALIZED (SELECT *, basket % {0} AS chunk FROM " + E + "), s(chunk, basket, items, last) AS (SELECT chunk, basket, CAST(item AS VARCHAR), item FROM e UNION ALL SELECT s.chunk, s.basket, s.items || ',' || e.item, e.item FROM s JOIN e USING (basket) WHERE e.item > s.last)"
EVERY = f"WITH RECURSIVE {SUBSETS.format(1)} SELECT items, count(*) AS support FROM s GROUP BY items HAVING count(*) >= {SUPPORT}"


@query(f"""WITH RECURSIVE {SUBSETS.format(CHUNKS)}, n AS (SELECT chunk, count(DISTINCT basket) AS n FROM e GROUP BY chunk),
l AS (SELECT chunk, greatest(1, floor({SUPPORT} * n / (SELECT sum(n) FROM n))) AS least FROM n),
c AS (SELECT chunk, items, count(*) AS c FROM s GROUP BY ALL) SELECT items, count(*) AS chunks FROM c JOIN l USING (chunk) WHERE c >= least GROUP BY items""")
def son_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(itemsets.chunk_candidates(_rows(spark, sf_dir), F.pmod("basket", F.lit(CHUNKS)), SUPPORT))


@query(EVERY)
def son_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    candidates = itemsets.chunk_candidates(rows, F.pmod("basket", F.lit(CHUNKS)), SUPPORT)
    return _shown(itemsets.count_candidates(rows, candidates, SUPPORT))


@query(EVERY)
def fpgrowth_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(itemsets.by_growth(_rows(spark, sf_dir), SUPPORT, deal=parts(spark, sf_dir)))

"""Data exploration, joins and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamine.functions.text import PUNCTUATION, is_stopword, plain_words, stopwords_sql
from stratamine.operators import explore, relational
from stratamine.plans.registry import R, query, reviews, table

PLAIN = f"unnest(list_transform(string_split(lower(text), ' '), lambda w: translate(w, '{PUNCTUATION}', '')))"


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE year(d) = 1997) AS in_year, count(DISTINCT u) AS users FROM {R}")
def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.review_counts(reviews(spark, sf_dir), 1997, "u", "d")


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10")
def top_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.top_keys(table(spark, sf_dir, "orders"), "o_custkey", 10)


@query(f"SELECT word, count(*) AS n FROM (SELECT {PLAIN} AS word FROM documents) WHERE word <> '' AND word NOT IN {stopwords_sql()} GROUP BY word ORDER BY n DESC, word LIMIT 20")
def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.top_words(table(spark, sf_dir, "documents"), "text", 20)


def _category(join: str) -> str:
    return f"""WITH st AS (SELECT b, sum(s) AS s, count(s) AS c FROM {R} GROUP BY b),
    x AS (SELECT unnest(string_split(p_name, ' ')) AS category, st.s, st.c FROM part {join} JOIN st ON p_partkey = b)
    SELECT category, round(coalesce(sum(s) / nullif(sum(c), 0), 0), 6) AS avg_stars FROM x GROUP BY category ORDER BY avg_stars DESC, category LIMIT 10"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("b"), F.split("p_name", " ").alias("names"))


@query(_category(""))
def category_avg_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.category_average(reviews(spark, sf_dir), _parts(spark, sf_dir), "b", "s", "names", 10)


@query(_category("LEFT"))
def category_avg_keep_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.category_average(reviews(spark, sf_dir), _parts(spark, sf_dir), "b", "s", "names", 10, keep_empty=True)


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 30")
def frequent_business(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.more_than(table(spark, sf_dir, "lineitem"), "l_partkey", 30)


@query("""WITH c AS (SELECT ascii(substr(CAST(l_partkey AS VARCHAR), 1, 1)) % 27 AS part, count(*) AS n FROM lineitem GROUP BY 1)
SELECT CAST(r.range AS INTEGER) AS part, coalesce(c.n, 0) AS n_items FROM range(27) r LEFT JOIN c ON c.part = r.range""")
def partition_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.partition_profile(table(spark, sf_dir, "lineitem"), explore.by_first_character("l_partkey", 27), 27)


@query("""SELECT CAST(r.range AS INTEGER) AS part, coalesce(c.n, 0) AS n_items FROM range(27) r
LEFT JOIN (SELECT ascii(substr(CAST(l_partkey AS VARCHAR), 1, 1)) % 27 AS part, count(*) AS n FROM lineitem GROUP BY 1) c ON c.part = r.range""")
def partition_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey")
    return explore.current_profile(explore.deal(rows, explore.by_first_character("l_partkey", 27), 27))


@query("""SELECT DISTINCT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')""")
def state_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    asia = table(spark, sf_dir, "region").where("r_name = 'ASIA'").join(table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, sf_dir, "customer").join(asia, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"))
    return relational.semi(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), customers, "o_custkey").distinct()


@query(f"SELECT source, word, count(*) AS n FROM (SELECT source, {PLAIN} AS word FROM documents) WHERE word <> '' AND word NOT IN {stopwords_sql()} GROUP BY 1, 2 HAVING count(*) >= 5")
def stopword_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("source", F.explode(plain_words(F.col("text"))).alias("word"))
    kept = words.where((F.col("word") != "") & ~is_stopword(F.col("word")))
    return kept.groupBy("source", "word").agg(F.count("*").alias("n")).where("n >= 5")


@query("""WITH p AS (SELECT DISTINCT n_nationkey AS a, n_regionkey AS b FROM nation),
x AS (SELECT a AS id, b AS o FROM p UNION SELECT b, a FROM p)
SELECT id, string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) AS others FROM x GROUP BY id""")
def adjacency_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("b")).distinct()
    return relational.merged_adjacency(pairs, "a", "b").select("id", F.array_join(F.transform("others", lambda x: x.cast("string")), ",").alias("others"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS idx FROM (SELECT DISTINCT c_custkey FROM customer WHERE c_custkey IS NOT NULL)")
def dictionary_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.dense_index(table(spark, sf_dir, "customer"), "c_custkey")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))


@query("SELECT DISTINCT o_custkey AS k FROM orders")
def set_ops_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sides(spark, sf_dir)[0].distinct()


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer")
def set_ops_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return a.intersect(b)


@query("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def set_ops_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return a.union(b).distinct()


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_ops_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return b.subtract(a)

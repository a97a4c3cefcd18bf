"""Similar parts by customers, text profiles of sources, and collaborative filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamine.functions.hashing import PRIME, family, family_sql
from stratamine.functions.settle import dealt
from stratamine.functions.text import SPLITTERS, stopwords_sql
from stratamine.operators import recommend, similarity
from stratamine.plans.registry import RA, parts, query, reviews, table

ITEM_HASHES, USER_HASHES = family(35, 11), family(30, 12)
THRESHOLD, PROFILE = 0.1, 200


def _ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.averaged(dealt(reviews(spark, sf_dir), parts(spark, sf_dir), "u", "b"), "u", "b", "s")


def _overlap(key: str, other: str) -> str:
    return f"""ra AS MATERIALIZED (SELECT * FROM {RA}), sz AS (SELECT {key} AS k, count(*) AS n FROM ra GROUP BY 1),
    ov AS (SELECT x.{key} AS k1, y.{key} AS k2, count(*) AS "both" FROM ra x JOIN ra y ON x.{other} = y.{other} AND x.{key} < y.{key} GROUP BY 1, 2),
    j AS (SELECT k1, k2, "both", round("both" / (p.n + q.n - "both"), 6) AS jaccard FROM ov JOIN sz p ON p.k = k1 JOIN sz q ON q.k = k2)"""


@query(f'WITH {_overlap("b", "u")} SELECT * FROM j WHERE jaccard >= {THRESHOLD}')
def jaccard_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.jaccard_pairs(_ratings(spark, sf_dir), "b", "u", THRESHOLD, deal=parts(spark, sf_dir))


@query(f'WITH {_overlap("u", "b")} SELECT * FROM j WHERE "both" >= 3 AND jaccard >= 0.01')
def jaccard_min_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.jaccard_pairs(_ratings(spark, sf_dir), "u", "b", 0.01, 3, parts(spark, sf_dir))


def _signature(key: str, other: str, hashes) -> str:
    return f"sg AS MATERIALIZED (SELECT {key} AS k, i, min((h.ha * ({other} % {PRIME}) + h.hb) % {PRIME}) AS m FROM ra CROSS JOIN {family_sql(hashes)} GROUP BY 1, 2), cd AS MATERIALIZED (SELECT DISTINCT x.k AS k1, y.k AS k2 FROM sg x JOIN sg y ON x.i = y.i AND x.m = y.m AND x.k < y.k)"


@query(f"WITH ra AS (SELECT * FROM {RA}), {_signature('b', 'u', ITEM_HASHES)} SELECT k, i, m FROM sg")
def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.signatures(_ratings(spark, sf_dir), "b", F.col("u"), ITEM_HASHES)


@query(f"WITH ra AS (SELECT * FROM {RA}), {_signature('b', 'u', ITEM_HASHES)} SELECT k1, k2 FROM cd")
def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.banded_pairs(similarity.signatures(_ratings(spark, sf_dir), "b", F.col("u"), ITEM_HASHES), deal=parts(spark, sf_dir))


@query(f"WITH {_overlap('b', 'u')}, {_signature('b', 'u', ITEM_HASHES)} SELECT j.* FROM j JOIN cd USING (k1, k2) WHERE jaccard >= {THRESHOLD}")
def lsh_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.banded_similar(_ratings(spark, sf_dir), "b", "u", F.col("u"), ITEM_HASHES, THRESHOLD, deal=parts(spark, sf_dir))


@query(f"WITH {_overlap('b', 'u')}, {_signature('b', 'u', ITEM_HASHES)} SELECT (SELECT count(*) FROM j JOIN cd USING (k1, k2) WHERE jaccard >= {THRESHOLD}) AS found, (SELECT count(*) FROM j WHERE jaccard >= {THRESHOLD}) AS there")
def lsh_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = jaccard_exact(spark, sf_dir).select(F.lit(0).alias("f")).unionByName(lsh_jaccard(spark, sf_dir).select(F.lit(1).alias("f")))
    return marks.agg(F.count_if(F.col("f") == 1).alias("found"), F.count_if(F.col("f") == 0).alias("there"))


COUNTS = f"""wc AS MATERIALIZED (SELECT source AS k, word, count(*) AS n FROM (SELECT source, unnest(regexp_split_to_array(lower(trim(text)), '{SPLITTERS.replace("'", "''")}')) AS word FROM documents)
WHERE word <> '' AND word NOT IN {stopwords_sql()} GROUP BY 1, 2)"""
TF = "tf AS (SELECT k, word, n / max(n) OVER (PARTITION BY k) AS tf FROM wc)"
IDF = "idf AS (SELECT word, log2((SELECT count(DISTINCT source) FROM documents) / count(*)) AS idf FROM wc GROUP BY word)"
TOP = f"pr AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY tfidf DESC, word) AS rank FROM (SELECT k, word, round(tf * idf, 6) AS tfidf FROM tf JOIN idf USING (word))) WHERE rank <= {PROFILE})"


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.word_counts(table(spark, sf_dir, "documents"), "source", "text")


def _keys(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "documents").agg(F.countDistinct("source")).first()[0]


@query(f"WITH {COUNTS} SELECT * FROM wc")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


@query(f"WITH {COUNTS}, {TF} SELECT k, word, round(tf, 6) AS tf FROM tf")
def tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.term_frequency(_counts(spark, sf_dir)).withColumn("tf", F.round("tf", 6))


@query(f"WITH {COUNTS}, {IDF} SELECT word, round(idf, 6) AS idf FROM idf")
def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.inverse_frequency(_counts(spark, sf_dir), _keys(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


@query(f"WITH {COUNTS}, {TF}, {IDF}, {TOP} SELECT * FROM pr")
def tfidf_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.profiles(_counts(spark, sf_dir), _keys(spark, sf_dir), PROFILE)


@query("SELECT lang, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents GROUP BY lang")
def user_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


@query(f"""WITH {COUNTS}, {TF}, {IDF}, {TOP}, own AS (SELECT DISTINCT v.u, pr.word FROM (SELECT DISTINCT lang AS u, source AS k FROM documents) v JOIN pr USING (k)),
nu AS (SELECT u, count(*) AS nu FROM own GROUP BY u), nk AS (SELECT k, count(*) AS nk FROM pr GROUP BY k),
bo AS (SELECT u, k, count(*) AS c FROM own JOIN pr USING (word) GROUP BY u, k)
SELECT u, k, round(c / (sqrt(nu) * sqrt(nk)), 6) AS cosine FROM bo JOIN nu USING (u) JOIN nk USING (k) WHERE round(c / (sqrt(nu) * sqrt(nk)), 6) >= 0.01""")
def content_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = similarity.profiles(_counts(spark, sf_dir), _keys(spark, sf_dir), PROFILE)
    return similarity.content_cosine(profile, table(spark, sf_dir, "documents"), "lang", "source", 0.01)


def _pearson(x: str, y: str) -> str:
    return f"coalesce(round(covar_pop({x}, {y}) / nullif(round(stddev_pop({x}) * stddev_pop({y}), 9), 0), 6), 0)"


def _pairs(key: str, other: str, source: str = "ra") -> str:
    return f'SELECT x.{key} AS k1, y.{key} AS k2, count(*) AS "both", {_pearson("x.s", "y.s")} AS sim FROM {source} x JOIN {source} y ON x.{other} = y.{other} AND x.{key} < y.{key} GROUP BY 1, 2 HAVING count(*) >= 3'


ITEMS = f"ra AS MATERIALIZED (SELECT * FROM {RA}), en AS (SELECT * FROM ra WHERE b IN (SELECT b FROM ra GROUP BY b HAVING sum(reviews) >= 3)), im AS MATERIALIZED (SELECT k1, k2, sim FROM ({_pairs('b', 'u', 'en')}) WHERE sim > 0)"
USERS = f"{_overlap('u', 'b')}, {_signature('u', 'b', USER_HASHES)}, um AS MATERIALIZED (SELECT p.k1, p.k2, p.sim FROM ({_pairs('u', 'b')}) p JOIN cd USING (k1, k2) JOIN j USING (k1, k2) WHERE j.\"both\" >= 3 AND j.jaccard >= 0.01 AND p.sim > 0)"


@query(f"WITH ra AS MATERIALIZED (SELECT * FROM {RA}) {_pairs('b', 'u')}")
def pearson_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.pearson_pairs(_ratings(spark, sf_dir), "b", "u", deal=parts(spark, sf_dir))


@query(f"WITH {ITEMS} SELECT * FROM im")
def cf_item_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.item_model(_ratings(spark, sf_dir), deal=parts(spark, sf_dir))


@query(f"WITH {USERS} SELECT * FROM um")
def cf_user_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.user_model(_ratings(spark, sf_dir), USER_HASHES, deal=parts(spark, sf_dir))


@query(f"""WITH {ITEMS}, w AS (SELECT k1 AS k, k2 AS near, sim FROM im UNION ALL SELECT k2, k1, sim FROM im),
n AS (SELECT t.u, t.b, r.s, w.sim, row_number() OVER (PARTITION BY t.u, t.b ORDER BY w.sim DESC, w.near DESC) AS n FROM ra t JOIN w ON w.k = t.b JOIN ra r ON r.u = t.u AND r.b = w.near)
SELECT u, b, round(sum(s * sim) / sum(sim), 6) AS stars FROM n WHERE n <= 7 GROUP BY u, b HAVING round(sum(s * sim) / sum(sim), 6) > 0""")
def cf_item_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings = _ratings(spark, sf_dir)
    return recommend.item_predictions(ratings, ratings, recommend.item_model(ratings, deal=parts(spark, sf_dir)))


@query(f"""WITH {USERS}, w AS (SELECT k1 AS k, k2 AS near, sim FROM um UNION ALL SELECT k2, k1, sim FROM um),
me AS (SELECT u, avg(s) AS mean, sum(s) AS total, count(*) AS n_items FROM ra GROUP BY u),
g AS (SELECT u AS near, b, s, CASE WHEN n_items > 1 THEN (total - s) / (n_items - 1) ELSE s END AS rest FROM ra JOIN me USING (u)),
n AS (SELECT t.u, t.b, g.s, g.rest, w.sim, row_number() OVER (PARTITION BY t.u, t.b ORDER BY w.sim DESC, w.near DESC) AS n FROM ra t JOIN w ON w.k = t.u JOIN g ON g.near = w.near AND g.b = t.b),
l AS (SELECT u, b, sum((s - rest) * sim) / sum(sim) AS lift FROM n WHERE n <= 7 GROUP BY u, b)
SELECT u, b, round(mean + lift, 6) AS stars FROM l JOIN me USING (u) WHERE round(mean + lift, 6) > 0""")
def cf_user_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings = _ratings(spark, sf_dir)
    return recommend.user_predictions(ratings, ratings, recommend.user_model(ratings, USER_HASHES, deal=parts(spark, sf_dir)))

"""Clusters of embeddings."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamine.functions.settle import settle
from stratamine.operators import cluster
from stratamine.plans.registry import query, table

K, ROUNDS = 8, 4
X = "x AS MATERIALIZED (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
MEANS = "m AS MATERIALIZED (SELECT label AS c, i, avg(v) AS y FROM x GROUP BY 1, 2)"
ASSIGN = "a AS MATERIALIZED (SELECT vec_id, c, d FROM (SELECT vec_id, c, sum((v - y) * (v - y)) AS d, row_number() OVER (PARTITION BY vec_id ORDER BY round(sum((v - y) * (v - y)), 9), c) AS n FROM x JOIN m USING (i) GROUP BY vec_id, c) WHERE n = 1)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null and vec_id is not null")
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")


def _by_label(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    points = _points(spark, sf_dir)
    centres = cluster.means(points, "label")
    return points.withColumn("b", cluster.nearest("x", centres)), centres


@query(f"WITH {X}, {MEANS}, {ASSIGN} SELECT vec_id AS id, c AS cluster, round(sqrt(d), 5) AS distance FROM a")
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _by_label(spark, sf_dir)
    return rows.select("id", F.col("b.c").alias("cluster"), F.round(F.sqrt("b.d"), 5).alias("distance"))


@query(f"WITH {X}, {MEANS}, {ASSIGN} SELECT a.c AS cluster, i - 1 AS dim, round(avg(v), 5) AS mean FROM a JOIN x USING (vec_id) GROUP BY 1, 2")
def kmeans_lloyd_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _by_label(spark, sf_dir)
    made = cluster.stats(rows.select("id", "x", F.col("b.c").alias("cluster")), "cluster")
    return made.select("cluster", "n", F.posexplode("total").alias("dim", "t")).select("cluster", "dim", F.round(F.col("t") / F.col("n"), 5).alias("mean"))


def _starts() -> tuple[list[str], str]:
    """The steps to the farthest-first starts, and what selects them."""
    steps = [X, "p1 AS MATERIALIZED (SELECT min(vec_id) AS id FROM embeddings)", "d1 AS MATERIALIZED (SELECT x.vec_id, sum((x.v - y.v) * (x.v - y.v)) AS d FROM x JOIN x y USING (i) WHERE y.vec_id = (SELECT id FROM p1) GROUP BY 1)"]
    for i in range(2, K + 1):
        steps.append(f"p{i} AS MATERIALIZED (SELECT vec_id AS id FROM d{i - 1} ORDER BY d DESC, vec_id LIMIT 1)")
        steps.append(f"d{i} AS MATERIALIZED (SELECT d{i - 1}.vec_id, least(any_value(d), sum((x.v - y.v) * (x.v - y.v))) AS d FROM d{i - 1} JOIN x USING (vec_id) JOIN x y USING (i) WHERE y.vec_id = (SELECT id FROM p{i}) GROUP BY 1)")
    return steps, " UNION ALL ".join(f"SELECT {i - 1} AS place, id FROM p{i}" for i in range(1, K + 1))


def _farthest() -> str:
    steps, chosen = _starts()
    return f"WITH {', '.join(steps)} {chosen}"


def _lloyd(rounds: int) -> str:
    """Rounds after the one in which no point moves change nothing, so all are written out."""
    steps, chosen = _starts()
    steps.append("v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL)")
    steps.append(f"c0 AS MATERIALIZED (SELECT place AS c, e AS y FROM ({chosen}) JOIN v ON id = vec_id)")
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, c FROM (SELECT vec_id, c, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(e, y), c) AS n FROM v, c{r}) WHERE n = 1)")
        mean = f"SELECT c, list(t ORDER BY i) AS t FROM (SELECT c, i, avg(v) AS t FROM a{r} JOIN x USING (vec_id) GROUP BY 1, 2) GROUP BY 1"
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(t, y) AS y FROM c{r} o LEFT JOIN ({mean}) m ON o.c = m.c)")
    return f"WITH {', '.join(steps)} SELECT vec_id AS id, c AS cluster FROM a{rounds}"


@query(_farthest())
def farthest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = cluster.farthest_first(_points(spark, sf_dir), K)
    return spark.createDataFrame([(i, c) for i, (c, _) in enumerate(chosen)], "place int, id long")


STATS = "st AS MATERIALIZED (SELECT label AS c, i, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM x GROUP BY 1, 2), sd AS (SELECT c, i, s / n AS y, sqrt(greatest(q / n - (s / n) * (s / n), 0)) AS z FROM st)"


@query(f"WITH {X}, {STATS} SELECT c AS label, i - 1 AS dim, n, round(s, 5) AS total, round(q, 5) AS squares FROM st")
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = cluster.stats(_points(spark, sf_dir), "label")
    rows = made.select("label", "n", F.posexplode(F.arrays_zip("total", "squares")).alias("dim", "t"))
    return rows.select("label", "dim", "n", F.round("t.total", 5).alias("total"), F.round("t.squares", 5).alias("squares"))


def _summaries(spark: SparkSession, sf_dir: str) -> list:
    made = cluster.stats(_points(spark, sf_dir), "label").collect()  # a row a label
    return sorted((r["label"], r["n"], list(r["total"]), list(r["squares"])) for r in made)


@query(f"""WITH {X}, {STATS} SELECT id, cluster, distance, within FROM (SELECT vec_id AS id, c AS cluster, round(sqrt(sum(CASE WHEN z > 1e-12 THEN ((v - y) / z) * ((v - y) / z) ELSE 0 END)), 5) AS distance,
sqrt(sum(CASE WHEN z > 1e-12 THEN ((v - y) / z) * ((v - y) / z) ELSE 0 END)) < 2 * sqrt(count(*)) AS within,
row_number() OVER (PARTITION BY vec_id ORDER BY sum(CASE WHEN z > 1e-12 THEN ((v - y) / z) * ((v - y) / z) ELSE 0 END), c) AS n FROM x JOIN sd USING (i) GROUP BY vec_id, c) WHERE n = 1""")
def mahalanobis_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    summaries = _summaries(spark, sf_dir)
    limit = 2 * sqrt(len(summaries[0][2]))
    rows = _points(spark, sf_dir).withColumn("b", cluster.mahalanobis_nearest("x", summaries))
    return rows.select("id", F.col("b.c").alias("cluster"), F.round("b.d", 5).alias("distance"), (F.col("b.d") < limit).alias("within"))


@query(f"""WITH {X}, {STATS} SELECT p.c AS i, r.c AS j, round(sqrt(sum(CASE WHEN r.z > 1e-12 THEN ((p.y - r.y) / r.z) * ((p.y - r.y) / r.z) ELSE 0 END)), 5) AS distance
FROM sd p JOIN sd r ON p.i = r.i AND p.c < r.c GROUP BY 1, 2 HAVING sqrt(sum(CASE WHEN r.z > 1e-12 THEN ((p.y - r.y) / r.z) * ((p.y - r.y) / r.z) ELSE 0 END)) < 2 * sqrt(count(*))""")
def cs_merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    summaries = _summaries(spark, sf_dir)
    found = cluster.merge_candidates(summaries, 2 * sqrt(len(summaries[0][2])))
    return spark.createDataFrame([(i, j, round(d, 5)) for i, j, d in found], "i int, j int, distance double")


@query(_lloyd(30))
def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.kmeans(_points(spark, sf_dir).select("id", "x"), K, 30).select("id", "cluster")


def _bfr(spark: SparkSession, sf_dir: str) -> cluster.BFR:
    """Rounds are ranges of ids that together hold all points."""
    points = settle(_points(spark, sf_dir).select("id", "x"))
    cut = points.agg(F.percentile_approx("id", [i / ROUNDS for i in range(1, ROUNDS)]).alias("p")).first()["p"]
    edges = [None, *cut, None]
    chunks = []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        part = points if low is None else points.where(F.col("id") > low)
        chunks.append(part if high is None else part.where(F.col("id") <= high))
    dim = points.select(F.size("x").alias("d")).first()["d"]
    return cluster.bfr(chunks, K, dim)


@query()
def bfr_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_bfr(spark, sf_dir).log, cluster.ROUND)


@query()
def bfr_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bfr(spark, sf_dir).last()

"""Graphs of customers who bought the same parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamine.functions.settle import dealt, settle
from stratamine.operators import graph
from stratamine.plans.registry import R, parts, query, reviews

ROUNDS, DEPTH, LEVELS = 5, 4, 16
#: There is at most one edge for so many customers, whatever the size of the tables: those with the most parts in common.
SHARED, PATHS = 4, 20


def _edges(spark: SparkSession, sf_dir: str, share: int) -> DataFrame:
    n = parts(spark, sf_dir)
    rows = dealt(reviews(spark, sf_dir).select("u", "b"), n, "u", "b").distinct()
    return settle(graph.strongest(rows, "u", "b", share, n))


def _e(share: int) -> str:
    return f"""ub AS MATERIALIZED (SELECT DISTINCT u, b FROM {R}), pc AS MATERIALIZED (SELECT x.u AS a, y.u AS b, count(*) AS c FROM ub x JOIN ub y ON x.b = y.b AND x.u < y.u GROUP BY 1, 2 HAVING count(*) >= 2),
    th AS (SELECT min(c) AS t FROM (SELECT c, sum(count(*)) OVER (ORDER BY c DESC) AS n FROM pc GROUP BY c) WHERE n <= (SELECT count(DISTINCT u) FROM ub) / {share}), pr AS MATERIALIZED (SELECT a, b FROM pc WHERE c >= (SELECT t FROM th)),
    e AS MATERIALIZED (SELECT a AS src, b AS dst FROM pr UNION ALL SELECT b, a FROM pr)"""


def _labels() -> str:
    steps = ["l0 AS MATERIALIZED (SELECT DISTINCT src AS id, src AS label FROM e)"]
    for i in range(1, ROUNDS + 1):
        steps.append(f"l{i} AS MATERIALIZED (SELECT id, label FROM (SELECT dst AS id, label, row_number() OVER (PARTITION BY dst ORDER BY count(*) DESC, label) AS n FROM e JOIN l{i - 1} ON src = id GROUP BY dst, label) WHERE n = 1)")
    return ", ".join(steps)


REACH = "rc(id, r) AS (SELECT DISTINCT src, src FROM e UNION SELECT e.dst, rc.r FROM rc JOIN e ON e.src = rc.id), cc AS (SELECT id, min(r) AS component FROM rc GROUP BY id)"


def _levels(roots: str, depth: int) -> str:
    steps = [f"f0 AS MATERIALIZED (SELECT id AS root, id AS node, 0 AS dist, 1::BIGINT AS sigma FROM {roots})", "a0 AS (SELECT * FROM f0)"]
    for i in range(1, depth + 1):
        steps.append(f"f{i} AS MATERIALIZED (SELECT root, dst AS node, {i} AS dist, sum(sigma)::BIGINT AS sigma FROM f{i - 1} JOIN e ON src = node WHERE NOT EXISTS (SELECT 1 FROM a{i - 1} a WHERE a.root = f{i - 1}.root AND a.node = dst) GROUP BY 1, 2)")
        steps.append(f"a{i} AS MATERIALIZED (SELECT * FROM a{i - 1} UNION ALL SELECT * FROM f{i})")
    return ", ".join(steps)


@query(f"WITH {_e(SHARED)} SELECT src, dst FROM e")
def cooccurrence_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, SHARED)


@query(f"WITH {_e(SHARED)} SELECT src AS id, count(*) AS degree FROM e GROUP BY 1")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_edges(spark, sf_dir, SHARED))


@query(f"WITH {_e(SHARED)} SELECT a, b FROM pr")
def mutual_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.mutual(_edges(spark, sf_dir, SHARED))


@query(f"WITH {_e(SHARED)}, {_labels()} SELECT id, label FROM l{ROUNDS}")
def label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.label_propagation(_edges(spark, sf_dir, SHARED), ROUNDS)


@query(f"WITH {_e(SHARED)}, {_labels()} SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS members FROM l{ROUNDS} GROUP BY label")
def lpa_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.communities(graph.label_propagation(_edges(spark, sf_dir, SHARED), ROUNDS))
    return found.select(F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query(f"WITH RECURSIVE {_e(SHARED)}, {REACH} SELECT id, component FROM cc")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(_edges(spark, sf_dir, SHARED))


@query(f"WITH {_e(SHARED)}, {_levels('(SELECT min(src) AS id FROM e)', DEPTH)} SELECT root, node, dist, sigma FROM a{DEPTH}")
def bfs_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir, SHARED)
    return graph.shortest_paths(edges, edges.agg(F.min("src").alias("id")), DEPTH)


@query(f"""WITH {_e(PATHS)}, {_levels('(SELECT DISTINCT src AS id FROM e)', LEVELS)}
SELECT e.src AS a, e.dst AS b, round(sum(x.sigma * y.sigma / z.sigma), 6) AS betweenness FROM e JOIN a{LEVELS} x ON x.node = e.src JOIN a{LEVELS} y ON y.node = e.dst
JOIN a{LEVELS} z ON z.root = x.root AND z.node = y.root WHERE e.src < e.dst AND x.dist + 1 + y.dist = z.dist GROUP BY 1, 2""")
def edge_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_betweenness(_edges(spark, sf_dir, PATHS))


@query(f"""WITH RECURSIVE {_e(SHARED)}, {REACH}, k AS (SELECT x.component AS g, count(*) AS k, count(*) FILTER (WHERE x.component = y.component) AS i FROM e JOIN cc x ON x.id = src JOIN cc y ON y.id = dst GROUP BY 1)
SELECT round(sum(i) / sum(k) - sum(k * k) / (sum(k) * sum(k)), 6) AS modularity FROM k""")
def modularity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir, SHARED)
    return graph.modularity(edges, graph.components(edges), "component")


@query()
def girvan_newman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.girvan_newman(_edges(spark, sf_dir, PATHS))

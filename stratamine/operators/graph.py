"""Graphs as edge tables (src, dst), both orders present: co-occurrence, labels, components, paths, cuts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamine.functions.settle import settle
from stratamine.functions.ship import ship
from stratamine.operators.relational import shared


def co_occurrence(rows: DataFrame, key: str, member: str, at_least: int) -> DataFrame:
    """Edges between keys that share at least so many members; rows are distinct (key, member)."""
    return _both_ways(shared(rows, key, member, at_least))


def strongest(rows: DataFrame, key: str, member: str, share: int, deal: int | None = None) -> DataFrame:
    """Edges between keys that share at least t members: the least t from 2 on that leaves one edge for ``share`` keys at
    most. Rows are distinct (key, member). None if no t does."""
    pairs = settle(shared(rows, key, member, 2, deal))
    most, total, least = rows.select(key).distinct().count() / share, 0, None
    for r in pairs.groupBy("both").agg(F.count("*").alias("n")).orderBy(F.desc("both")).collect():  # a row for each number shared
        total += r["n"]
        if total > most:
            break
        least = r["both"]
    return _both_ways(pairs.where(F.col("both") >= F.lit(least).cast("long")))


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array(F.struct(F.col("k1").alias("src"), F.col("k2").alias("dst")), F.struct(F.col("k2").alias("src"), F.col("k1").alias("dst")))).alias("e")).select("e.*")


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def mutual(directed: DataFrame) -> DataFrame:
    """The motif a -> b -> a: pairs a < b with an edge each way."""
    x, y = directed.alias("x"), directed.alias("y")
    return x.join(y, (F.col("x.src") == F.col("y.dst")) & (F.col("x.dst") == F.col("y.src")) & (F.col("x.src") < F.col("x.dst"))).select(F.col("x.src").alias("a"), F.col("x.dst").alias("b")).distinct()


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """id, label after so many synchronous rounds: each vertex takes the label that most neighbours have, the smallest
    of equal ones."""
    labels = vertices(edges).select("id", F.col("id").alias("label"))
    for _ in range(rounds):
        votes = edges.join(labels, F.col("src") == F.col("id")).groupBy("dst", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("dst").agg(F.max(F.struct("n", (-F.col("label")).alias("m"))).alias("b"))
        labels = settle(best.select(F.col("dst").alias("id"), (-F.col("b.m")).alias("label")))
    return labels


def communities(labels: DataFrame, label: str = "label") -> DataFrame:
    """members (sorted arrays) of each label."""
    return labels.groupBy(label).agg(F.sort_array(F.collect_list("id")).alias("members")).select("members")


def components(edges: DataFrame) -> DataFrame:
    """id, component (its smallest id), by least neighbours and jumps along pointers until nothing changes."""
    now = settle(vertices(edges).select("id", F.col("id").alias("component")))
    while True:
        near = edges.join(now, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(F.min("component").alias("least"))
        step = now.join(near, "id").select("id", F.least("component", "least").alias("component"), F.col("component").alias("before"))
        jump = step.select(F.col("id").alias("j"), F.col("component").alias("to"))
        new = settle(step.join(jump, F.col("component") == F.col("j")).select("id", F.col("to").alias("component"), "before"))
        changed = new.where("component <> before").limit(1).count()
        now = new.drop("before")
        if not changed:
            return now


def shortest_paths(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """root, node, dist and sigma (the number of shortest paths) for each root, up to a depth. All roots go on
    together, a level at a time."""
    edges = settle(edges)
    level = settle(roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("dist"), F.lit(1).cast("bigint").alias("sigma")))
    seen, d = level, 0
    while depth is None or d < depth:
        d += 1
        ahead = level.join(edges, F.col("node") == F.col("src")).groupBy("root", F.col("dst").alias("node")).agg(F.sum("sigma").alias("sigma"))
        level = settle(ahead.join(seen, ["root", "node"], "left_anti").select("root", "node", F.lit(d).alias("dist"), "sigma"))
        if not level.limit(1).count():
            break
        seen = settle(seen.unionByName(level))
    return seen


def edge_betweenness(edges: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """a < b and betweenness of each undirected edge: credits flow from the farthest level of each root's paths back
    to the root; each pair of ends is met from both, so sums are halved."""
    paths = shortest_paths(edges, vertices(edges)) if paths is None else paths
    deepest = paths.agg(F.max("dist").alias("d")).first()["d"]
    up = paths.select("root", F.col("node").alias("src"), F.col("dist").alias("d0"), F.col("sigma").alias("s0"))
    steps = settle(up.join(edges, "src").join(paths.select("root", F.col("node").alias("dst"), F.col("dist").alias("d1"), F.col("sigma").alias("s1")), ["root", "dst"]).where("d1 = d0 + 1"))
    flow, total = None, None
    for d in range(deepest or 0, 0, -1):
        here = steps.where(F.col("d1") == d)
        credit = F.lit(1.0) if flow is None else F.lit(1.0) + F.coalesce("below", F.lit(0.0))
        if flow is not None:
            here = here.join(flow, ["root", "dst"], "left")
        here = here.select("root", "src", "dst", (credit * F.col("s0") / F.col("s1")).alias("c"))
        flow = settle(here.groupBy("root", F.col("src").alias("dst")).agg(F.sum("c").alias("below")))
        part = here.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("c").alias("c"))
        total = settle(part if total is None else total.unionByName(part).groupBy("a", "b").agg(F.sum("c").alias("c")))
    if total is None:
        return edges.where("false").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0.0).alias("betweenness"))
    return total.select("a", "b", F.round(F.col("c") / 2, 6).alias("betweenness"))


def modularity(edges: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """One row: the modularity of a grouping (id, group) of the graph: over groups, the share of edges within less
    the square of the share of degrees. No edges: 0."""
    named = groups.select("id", F.col(group).alias("g"))
    ends = edges.join(named.toDF("src", "g1"), "src").join(named.toDF("dst", "g2"), "dst")
    by = ends.groupBy(F.col("g1").alias("g")).agg(F.count("*").alias("k"), F.count_if(F.col("g1") == F.col("g2")).alias("inside"))
    whole = by.agg(F.sum("k").alias("m2"), F.sum("inside").alias("inside"), F.sum(F.col("k") * F.col("k")).alias("squares"))
    return whole.select(F.round(F.coalesce(F.col("inside") / F.nullif("m2", F.lit(0)) - F.col("squares") / F.nullif(F.col("m2") * F.col("m2"), F.lit(0)), F.lit(0.0)), 6).alias("modularity"))


CUTS = "part long, step long, a long, b long, betweenness double, gain double"


def _cut_all(edges: list[tuple[int, int]], degree: dict[int, int], m2: int) -> list[tuple[int, int, float, float]]:
    """Cuts of one component until no edge is left: (a, b, betweenness, modularity's part of the component after)."""
    near: dict[int, set[int]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    original = [(a, b) for a, b in edges if a < b]
    left, out = set(original), []
    while left:
        between = dict.fromkeys(left, 0.0)
        for root in near:
            dist, sigma, order = {root: 0}, {root: 1}, [root]
            for v in order:
                for w in near[v]:
                    if w not in dist:
                        dist[w], sigma[w] = dist[v] + 1, 0
                        order.append(w)
                    if dist[w] == dist[v] + 1:
                        sigma[w] += sigma[v]
            credit = dict.fromkeys(order, 1.0)
            for w in reversed(order):
                for v in near[w]:
                    if dist[v] == dist[w] - 1:
                        c = credit[w] * sigma[v] / sigma[w]
                        between[min(v, w), max(v, w)] += c / 2
                        credit[v] += c
        (a, b), most = max(between.items(), key=lambda x: (round(x[1], 6), -x[0][0], -x[0][1]))
        left.remove((a, b))
        near[a].discard(b)
        near[b].discard(a)
        group = groups_of(near)
        inside, share = 0, {}
        for x, y in original:
            inside += 2 * (group[x] == group[y])
        for v, g in group.items():
            share[g] = share.get(g, 0) + degree[v]
        out.append((a, b, most, inside / m2 - sum(k * k for k in share.values()) / m2**2))
    return out


def groups_of(near: dict[int, set[int]]) -> dict[int, int]:
    group: dict[int, int] = {}
    for v in sorted(near):
        if v not in group:
            group[v], todo = v, [v]
            while todo:
                for w in near[todo.pop()]:
                    if w not in group:
                        group[w] = v
                        todo.append(w)
    return group


def girvan_newman(edges: DataFrame) -> DataFrame:
    """id, community and modularity of the best of all graphs that arise by cutting the edge with the highest
    betweenness, the uncut one first; no edges give no rows.

    A component's cuts don't depend on others', so each component is cut by itself, in one task; the sequence of all
    is merged by the largest next betweenness on the driver, which holds a number for each edge: this is for graphs
    of as many edges as one machine can cut anyway.
    """
    ship(edges.sparkSession)
    parts = settle(components(edges))
    dealt = edges.join(parts.toDF("src", "part"), "src")
    m2 = edges.count()
    if not m2:
        return parts.select("id", F.col("component").alias("community"), F.lit(0.0).alias("modularity"))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(pdf["src"].tolist(), pdf["dst"].tolist(), strict=True))
        degree = pdf.groupby("src").size().to_dict()
        made = _cut_all(rows, degree, m2)
        start = len(rows) / m2 - (len(rows) / m2) ** 2
        table = [(int(pdf["part"].iloc[0]), 0, -1, -1, 0.0, start)] + [(int(pdf["part"].iloc[0]), i, *x) for i, x in enumerate(made, 1)]
        return pd.DataFrame(table, columns=[c.split()[0] for c in CUTS.split(", ")])

    cuts = settle(dealt.groupBy("part").applyInPandas(cut, CUTS))
    by: dict[int, list] = {}
    for r in cuts.orderBy("part", "step").toLocalIterator():
        by.setdefault(r["part"], []).append(r)
    at = dict.fromkeys(by, 0)
    total = sum(rows[0]["gain"] for rows in by.values())
    best, best_at = total, dict(at)
    while heads := [(-round(by[p][at[p] + 1]["betweenness"], 6), by[p][at[p] + 1]["a"], by[p][at[p] + 1]["b"], p) for p in by if at[p] + 1 < len(by[p])]:
        p = min(heads)[3]
        total += by[p][at[p] + 1]["gain"] - by[p][at[p]]["gain"]
        at[p] += 1
        if total > best + 1e-12:
            best, best_at = total, dict(at)
    gone = {(r["a"], r["b"]) for p, rows in by.items() for r in rows[1 : best_at[p] + 1]}
    spark = edges.sparkSession
    lost = spark.createDataFrame([(a, b) for a, b in sorted(gone)], "a long, b long")
    kept = edges.join(lost, (F.least("src", "dst") == F.col("a")) & (F.greatest("src", "dst") == F.col("b")), "left_anti")
    found = components(kept) if kept.limit(1).count() else parts.where("false")
    return parts.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("community"), F.lit(round(best, 6)).alias("modularity"))


def most_between(betweenness: DataFrame) -> DataFrame:
    """The edge with the highest betweenness, the smallest of equal ones."""
    return betweenness.orderBy(F.desc("betweenness"), "a", "b").limit(1)


def nearest_first(df: DataFrame, by: str, *order: str) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("_n = 1").drop("_n")


def path_search(points: DataFrame, edges: DataFrame, start: Column, goal: Column, most: int = 10) -> DataFrame:
    """All shortest paths of at most ``most`` edges along directed edges (src, dst) from vertices (id and more) where
    ``start`` holds to those where ``goal`` does: path (array of ids). A vertex for which both hold is a path of its own.
    No rows if none is reached."""
    goals = points.where(goal).select(F.col("id").alias("g"))
    now = settle(points.where(start).select("id", F.array("id").alias("path")))
    seen = now.select("id").distinct()
    for step in range(most + 1):
        found = now.join(goals, F.col("id") == F.col("g"), "left_semi").select("path")
        if step == most or not now.limit(1).count() or found.limit(1).count():
            return found
        ahead = now.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        now = settle(ahead.distinct().join(seen, "id", "left_anti"))
        seen = settle(seen.unionByName(now.select("id").distinct()))
    return found

"""Clustering of points (id, x: array of double): K-means, farthest-first starts, BFR with its summaries."""

from __future__ import annotations

from functools import reduce
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamine.functions.settle import settle
from stratamine.functions.ship import ship


def squared(x: str | Column, y: str | Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v)


def literal(centres: list[tuple[int, list[float]]]) -> Column:
    """Centres as an array of (c, y) structs. There are few, so they stand in the plan and nothing is joined."""
    return F.array(*(F.struct(F.lit(int(c)).alias("c"), F.lit(np.asarray(y, float)).alias("y")) for c, y in centres))


def nearest(x: str | Column, centres: list[tuple[int, list[float]]]) -> Column:
    """The struct (d, c) of the nearest centre: squared distance, then the smallest number."""
    return F.array_min(F.transform(literal(centres), lambda t: F.struct(squared(x, t["y"]).alias("d"), t["c"].alias("c"))))


def stats(points: DataFrame, cluster: str) -> DataFrame:
    """cluster, n, total and squares (arrays by dimension)."""
    by_dim = points.select(cluster, F.posexplode("x").alias("i", "v")).groupBy(cluster, "i").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    rows = by_dim.groupBy(cluster).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "s", "q"))).alias("a"))
    return rows.select(cluster, "n", F.transform("a", lambda t: t["s"]).alias("total"), F.transform("a", lambda t: t["q"]).alias("squares"))


def means(points: DataFrame, cluster: str) -> list[tuple[int, list[float]]]:
    """(cluster, centre) on the driver, in order: as many as clusters."""
    return sorted((r[cluster], [v / r["n"] for v in r["total"]]) for r in stats(points, cluster).collect())


def farthest_first(points: DataFrame, k: int) -> list[tuple[int, list[float]]]:
    """k starting centres: the point with the smallest id, then each time the one farthest from all so far, equal ones
    by smallest id. Fewer points than k: all of them."""
    ship(points.sparkSession)
    first = points.orderBy("id").limit(1).collect()
    chosen = [(r["id"], list(r["x"])) for r in first]
    kind = points.schema["id"].dataType.simpleString()

    def farthest(batches):
        for batch in batches:
            if len(batch):
                gap = gaps(matrix(batch.column(1), centres.shape[1]), centres).min(1)
                gap = np.where(np.isnan(gap), -1.0, gap)
                ids = batch.column(0).take(pa.array(np.flatnonzero(gap == gap.max())))
                least = min(ids.to_pylist(), key=lambda i: (i is not None, i))
                at = int(np.flatnonzero((gap == gap.max()) & np.array([i == least for i in batch.column(0).to_pylist()]))[0])
                yield batch.slice(at, 1).append_column("d", pa.array(gap[at : at + 1]))

    while chosen and len(chosen) < k:
        centres = np.array([y for _, y in chosen], float)
        found = points.select("id", F.col("x").cast("array<double>").alias("x")).mapInArrow(farthest, f"id {kind}, x array<double>, d double")
        row = found.orderBy(F.desc("d"), "id").limit(1).first()
        if row is None or row["d"] <= 0:
            break
        chosen.append((row["id"], list(row["x"])))
    return chosen


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of numbers; one of another length is not a number in all places."""
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.full((len(sizes), dim), np.nan)
    out[sizes == dim] = flat[np.repeat(sizes == dim, sizes)].reshape(-1, dim)
    return out


def gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances [row, centre]."""
    return np.stack([((x - y) ** 2).sum(1) for y in centres], 1)


def _round(points: DataFrame, before: np.ndarray | None, centres: np.ndarray) -> tuple[bool, np.ndarray, np.ndarray]:
    """Whether a point's nearest centre changed, how many points each centre has, and their sums: a row for each task and
    centre goes to the driver, and no point is written."""

    def assign(batches):
        n, total, moved = np.zeros(len(centres)), np.zeros(centres.shape), False
        for batch in batches:
            x = matrix(batch.column(0), centres.shape[1])
            for low in range(0, len(x), 4096):
                some = x[low : low + 4096]
                at = gaps(some, centres).argmin(1)
                moved = moved or (before is not None and bool((gaps(some, before).argmin(1) != at).any()))
                n += np.bincount(at, minlength=len(centres))
                total += (at == np.arange(len(centres))[:, None]).astype(float) @ np.nan_to_num(some)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)), pa.int32()), pa.array(n), pa.array(list(total), pa.list_(pa.float64())), pa.array([moved] * len(n))], names=["c", "n", "total", "moved"])

    n, total, moved = np.zeros(len(centres)), np.zeros(centres.shape), False
    for r in points.select(F.col("x").cast("array<double>").alias("x")).mapInArrow(assign, "c int, n double, total array<double>, moved boolean").collect():
        n[r["c"]] += r["n"]
        total[r["c"]] += r["total"]
        moved = moved or r["moved"]
    return moved, n, total


def first_by_hash(points: DataFrame, k: int) -> list[tuple[int, list[float]]]:
    """k starting centres: those points whose ids have the least hashes, which is as good as random and repeats."""
    rows = points.orderBy(F.xxhash64("id"), "id").limit(k).collect()
    return [(r["id"], list(r["x"])) for r in rows]


def kmeans(points: DataFrame, k: int, rounds: int = 30, start: str = "farthest") -> DataFrame:
    """id, x, cluster (numbered by the order of the starts), by Lloyd's rounds until no point moves. ``start``: "farthest"
    or "random". An empty cluster keeps its centre."""
    starts = {"farthest": farthest_first, "random": first_by_hash}[start]
    points = settle(points)
    centres = [(i, y) for i, (_, y) in enumerate(starts(points, k))]
    if not centres:
        return points.withColumn("cluster", F.lit(0))
    ship(points.sparkSession)
    before, now = None, np.array([y for _, y in centres], float)
    for done in range(rounds + 1):
        moved, n, total = _round(points, before, now)
        if done == rounds or (done and not moved):
            break
        before, now = now, np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], now)
    return points.withColumn("cluster", nearest("x", list(enumerate(now.tolist()))).getField("c"))


def mahalanobis(x: Column, n: float, total: list[float], squares: list[float]) -> Column:
    """Distance in standard deviations; dimensions without any spread are passed over."""
    t, q = np.array(total) / n, np.array(squares) / n
    spread = np.sqrt(np.maximum(q - t * t, 0))
    weight = [1 / s if s > 1e-12 else 0.0 for s in spread]
    scaled = F.zip_with(F.zip_with(x, F.lit(t), lambda a, b: a - b), F.lit(np.array(weight)), lambda a, b: a * b)
    return F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda acc, v: acc + v * v))


def mahalanobis_nearest(x: str | Column, summaries: list[tuple[int, int, list[float], list[float]]]) -> Column:
    """The struct (d, c) of the nearest summary (cluster, n, total, squares)."""
    x = F.col(x) if isinstance(x, str) else x
    return F.array_min(F.array(*(F.struct(mahalanobis(x, n, t, q).alias("d"), F.lit(int(c)).alias("c")) for c, n, t, q in summaries)))


def _distance(y: np.ndarray, n: float, total: np.ndarray, squares: np.ndarray) -> float:
    t = total / n
    spread = np.sqrt(np.maximum(squares / n - t * t, 0))
    some = spread > 1e-12
    return float(np.sqrt((((y - t)[some] / spread[some]) ** 2).sum()))


def merge_candidates(summaries: list[tuple[int, int, list[float], list[float]]], limit: float) -> list[tuple[int, int, float]]:
    """(i, j, distance) of summaries i < j whose first centre lies within the limit of the second."""
    out = []
    for a, (i, n, t, _) in enumerate(summaries):
        for j, m, u, q in summaries[a + 1 :]:
            d = _distance(np.array(t) / n, m, np.array(u), np.array(q))
            if d < limit:
                out.append((i, j, d))
    return out


ROUND = "round_id int, nof_cluster_discard int, nof_point_discard long, nof_cluster_compression int, nof_point_compression long, nof_point_retained long"


class BFR:
    """Bradley-Fayyad-Reina: clusters too large for memory, in rounds. What stays on the driver are summaries (number,
    sum, sum of squares); points keep their cluster in tables that only grow. A round assigns all its points against the
    summaries as they were before it, so rows' order does not matter."""

    def __init__(self, k: int, alpha: int = 3, rounds: int = 5, init: int = 50_000):
        self.k, self.alpha, self.rounds, self.init = k, alpha, rounds, init
        self.discard: dict[int, list] = {}
        self.compressed: dict[int, list] = {}
        self.next = 0
        self.parts: list[DataFrame] = []  # id, cluster: what a step has assigned, never written again
        self.merged: dict[int, int] = {}  # compressed clusters and those that took them in; no number is used twice
        self.retained: DataFrame | None = None  # id, x
        self.log: list[tuple] = []

    @staticmethod
    def _summaries(points: DataFrame) -> dict[int, list]:
        return {r["cluster"]: [r["n"], np.array(r["total"]), np.array(r["squares"])] for r in stats(points, "cluster").collect()}  # a row a cluster

    @staticmethod
    def _fold(into: dict[int, list], more: dict[int, list]) -> None:
        for c, (n, t, q) in more.items():
            into[c] = [into[c][0] + n, into[c][1] + t, into[c][2] + q] if c in into else [n, t, q]

    def _keep(self, points: DataFrame) -> None:
        self.parts.append(settle(points.select("id", F.col("cluster").cast("int").alias("cluster"))))

    def _split(self, points: DataFrame) -> None:
        """Clusters of several points become compressed ones, single points stay retained."""
        k = min(self.alpha * self.k, points.count())
        if not k:
            self.retained = points.select("id", "x")
            return
        made = kmeans(points.select("id", "x"), k, self.rounds)
        size = made.groupBy("cluster").agg(F.count("*").alias("n"))
        made = settle(made.join(size, "cluster"))
        several = made.where("n > 1").withColumn("cluster", F.col("cluster") + self.next)
        self._fold(self.compressed, self._summaries(several))
        self.next += k
        self._keep(several)
        self.retained = settle(made.where("n = 1").select("id", "x"))

    def first(self, points: DataFrame) -> None:
        start = settle(points.orderBy("id").limit(self.init))  # the start's size is the method's parameter
        made = settle(kmeans(start, min(self.alpha * self.k, start.count()), self.rounds))
        size = made.groupBy("cluster").agg(F.count("*").alias("n"))
        single = settle(made.join(size, "cluster").where("n = 1").select("id", "x"))
        rest = points.join(single.select("id"), "id", "left_anti")
        done = settle(kmeans(rest, self.k, 100))
        self._fold(self.discard, self._summaries(done))
        self.next = max([self.next, *(c + 1 for c in self.discard)])
        self._keep(done)
        self._split(single)
        self._report()

    def _assign(self, points: DataFrame, into: dict[int, list], limit: float) -> DataFrame:
        if not into:
            return points
        best = settle(points.withColumn("b", mahalanobis_nearest("x", [(c, *s) for c, s in sorted(into.items())])))
        near = best.where(F.col("b.d") < limit).withColumn("cluster", F.col("b.c"))
        self._fold(into, self._summaries(near))
        self._keep(near)
        return best.where(~(F.col("b.d") < limit)).select("id", "x")

    def more(self, points: DataFrame, dim: int) -> None:
        limit = 2 * sqrt(dim)
        left = self._assign(points.select("id", "x"), self.discard, limit)
        left = self._assign(left, self.compressed, limit)
        self._split(settle(left if self.retained is None else left.unionByName(self.retained)))
        self._merge(limit)
        self._report()

    def _merge(self, limit: float) -> None:
        moved: dict[int, int] = {}
        for i, j, _ in merge_candidates([(c, *s) for c, s in sorted(self.compressed.items())], limit):
            if i not in moved and j not in moved:
                moved[i] = j
                self._fold(self.compressed, {j: self.compressed.pop(i)})
        self.merged |= moved

    def _report(self) -> None:
        count = lambda sets: int(sum(s[0] for s in sets.values()))
        self.log.append((len(self.log), len(self.discard), count(self.discard), len(self.compressed), count(self.compressed), self.retained.count()))

    def last(self) -> DataFrame:
        """id, cluster of every point: compressed clusters and retained points go to the nearest discard cluster."""
        every = [(c, *s) for c, s in sorted(self.discard.items())]
        near = lambda y: min(((_distance(y, *s[1:]), s[0]) for s in every))[1]
        home = {c: near(s[1] / s[0]) for c, s in self.compressed.items()}
        for c in self.merged:
            to = c
            while to in self.merged:
                to = self.merged[to]
            home[c] = home[to]
        rest = self.retained.select("id", mahalanobis_nearest("x", every).getField("c").alias("cluster"))
        found = reduce(DataFrame.unionByName, self.parts)
        if home:  # some entries for each round
            to = F.create_map(*(F.lit(v) for pair in home.items() for v in pair))
            found = found.withColumn("cluster", F.coalesce(to[F.col("cluster")], F.col("cluster")))
        return found.unionByName(rest)


def bfr(chunks: list[DataFrame], k: int, dim: int, **settings) -> BFR:
    """All rounds over chunks of points (id, x) in order."""
    out = BFR(k, **settings)
    for i, points in enumerate(chunks):
        if i:
            out.more(points, dim)
        else:
            out.first(points)
    return out

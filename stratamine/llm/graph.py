"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratamine.llm.ship import settled, ship

#: A key with more rows than this, and than a share of one in SHARES of all, is a hub.
HUB, SHARES = 10_000, 1000
#: So many edges or fewer are connected by one task: each round costs the driver a few tasks for every partition.
FEW = 100_000


def hub_join(rows: DataFrame, facts: DataFrame, key: str, total: int, count: str = "n", how: str = "inner") -> DataFrame:
    """rows joined with facts on ``key``. facts has one row a key and says in ``count`` how many of the ``total`` rows
    hold it. Hubs are fewer than SHARES, so their facts are broadcast and their rows stay where they are."""
    most = max(HUB, total // SHARES)
    if total <= most:
        return rows.join(facts, key, how)
    hubs = F.broadcast(facts.where(F.col(count) > most))
    others = rows.join(F.broadcast(facts.where(F.col(count) > most).select(key)), key, "left_anti")
    return rows.join(hubs, key).unionByName(others.join(facts.where(F.col(count) <= most), key, how))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a, b); component: the smallest id that can be reached.

    Alternates large stars (every neighbour that is larger is tied to the smallest neighbour) and small stars (every
    smaller neighbour is), which takes a number of rounds that grows with the logarithm of the ids. A star's centre
    is found by a grouped minimum, combined before the shuffle, and handed to a hub's edges by broadcast, so a hub
    costs no task more than its share. Each round's edges, two longs each, are written to the checkpoint folder; the
    rounds end when a round changes nothing or leaves no more than FEW edges, which one task connects. Loops and
    repeated edges do no harm; edges with a null end are left out; no edges give no rows.
    """
    now = settled(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark, before = _mark(now), None
    while mark[0] > FEW and mark != before:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
        larger = hub_join(both, least, "a", 2 * mark[0]).where("b > a")
        large = settled(larger.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = hub_join(large, least, "a", 2 * mark[0]).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = settled(small.select("e.*").where("a <> b").distinct())
        before, mark = mark, _mark(now)
    if mark[0] <= FEW:
        ship(now.sparkSession)
        kind = now.schema["a"].dataType
        return settled(now.coalesce(1).mapInArrow(_connect, T.StructType([T.StructField("id", kind), T.StructField("component", kind)])))
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def connected(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of edges between a and b, and the smallest that each reaches. Every root is tied to the smallest root beside
    it and paths are halved, until no edge joins two roots."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = ends[: len(a)], ends[len(a) :], np.arange(len(ids))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
    return ids, ids[root]


def _connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of one task's edges, FEW at most."""
    if found := [x for x in batches if x.num_rows]:
        a, b = (np.concatenate([x.column(i).to_numpy() for x in found]) for i in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(x, found[0].column(0).type) for x in connected(a, b)], names=["id", "component"])


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])

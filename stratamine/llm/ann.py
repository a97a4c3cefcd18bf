"""Approximate nearest neighbours by largest inner product: score-aware anisotropic quantisation, four-bit tables,
exact reranking.

Vectors are dealt into lists by their nearest centre; what a centre leaves over is quantised in two dimensions at a
time by 16 codewords each. The loss weighs the error along a vector more than across it, since only that part moves
the largest inner products; codes and codewords minimise it in turns. A search goes through the codes of all lists,
since the nearest of vectors without clusters lie in any of them: for each query the table of its products with the
codewords is read by the four-bit codes (two at a time), and the best by table are ranked by exact products of the
original vectors, in the task that holds them. Their k-th exact product is a floor: what the codes miss of a vector has
a known length, so its product is at most that by table and this length times the query's. Every vector that may still
reach the floor is ranked exactly too; rows that the codes fit badly cost time, not results.

Work is dealt in blocks: a bounded number of vectors, from whole lists or parts of long ones (cells), by a bounded part
of the queries. Each cell gives its best by table; a block returns what is best in all of its cells.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamine.llm.ship import ship

#: The largest number of vectors that centres and codewords are fitted on.
SAMPLE = 20_000
#: Vectors for each list, lists at most, vectors of a cell, vectors and queries of a block.
LIST, MOST_LISTS, PART, BLOCK, QUERIES = 4096, 4096, 8192, 65_536, 1024
CODES = 16
#: Best by table that are ranked exactly at first, in each cell.
RERANK = 200
#: Queries of a block that are looked up together; beyond this share of its vectors their products are taken at once.
TOGETHER, MANY = 64, 1 / 16
#: The share of a vector's norm from which inner products matter; it sets the weight of parallel error.
FROM = 0.2


def _kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        some = n > 0
        centres[some] = sums[some] / n[some, None]
        if (~some).any():
            centres[~some] = x[rng.integers(0, len(x), int((~some).sum()))]
    return centres


@dataclass
class Index:
    centres: np.ndarray  # [list, dim]
    words: np.ndarray  # [pair of dimensions, code, 2]
    weight: float  # of parallel error, less that of the other

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def place(self, x: np.ndarray) -> np.ndarray:
        return ((self.centres**2).sum(1) - 2 * x @ self.centres.T).argmin(1)

    def _pairs(self, x: np.ndarray) -> np.ndarray:
        odd = x.shape[1] % 2
        return np.pad(x, ((0, 0), (0, odd))).reshape(len(x), -1, 2)

    def parts(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the centre leaves over, and the direction of each vector, by pairs of dimensions."""
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return self._pairs(x - self.centres[lists]), self._pairs(x / np.maximum(norm, 1e-30))

    def code(self, rest: np.ndarray, way: np.ndarray, start: np.ndarray | None = None, rounds: int = 2) -> np.ndarray:
        """Codes [row, pair] by coordinate descent on |e|^2 + weight * (way . e)^2, e being the error."""
        n, m, _ = rest.shape
        words, rows = self.words, np.arange(n)
        code = np.stack([((words[j][None] - rest[:, j, None]) ** 2).sum(2).argmin(1) for j in range(m)], 1) if start is None else start.copy()
        error = rest - words[np.arange(m), code]
        along = (way * error).sum(2)
        total = along.sum(1)
        for _ in range(rounds):
            for j in range(m):
                e = rest[:, j, None] - words[j][None]
                a = (e * way[:, j, None]).sum(2)
                others = (total - along[:, j])[:, None]
                best = ((e**2).sum(2) + self.weight * (others + a) ** 2).argmin(1)
                code[:, j] = best
                total += a[rows, best] - along[:, j]
                along[:, j] = a[rows, best]
        return code

    def refine(self, rest: np.ndarray, way: np.ndarray, code: np.ndarray) -> None:
        """Codewords that minimise the loss for given codes, one pair of dimensions after the other."""
        along = (way * (rest - self.words[np.arange(rest.shape[1]), code])).sum(2)
        total = along.sum(1)
        for j in range(rest.shape[1]):
            u, r, c = way[:, j], rest[:, j], code[:, j]
            outer = self.weight * u[:, :, None] * u[:, None, :]
            left = np.eye(2)[None] * 1e-6 + np.stack([np.bincount(c, v, CODES) for v in (outer + np.eye(2)).reshape(len(u), 4).T], 1).reshape(CODES, 2, 2)
            goal = r + self.weight * u * ((total - along[:, j]) + (u * r).sum(1))[:, None]
            right = np.stack([np.bincount(c, v, CODES) for v in goal.T], 1)
            seen = np.bincount(c, minlength=CODES) > 0
            self.words[j][seen] = np.linalg.solve(left, right[:, :, None])[:, :, 0][seen]
            now = (u * (r - self.words[j][c])).sum(1)
            total += now - along[:, j]
            along[:, j] = now

    def missed(self, rest: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The length of what the codewords leave over."""
        return np.sqrt(((rest - self.words[np.arange(rest.shape[1]), code]) ** 2).sum((1, 2)))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products with the codewords, for two codes at a time: [query, pair of pairs, byte]."""
        one = np.einsum("qjd,jcd->qjc", self._pairs(q), self.words).astype(np.float32)
        if one.shape[1] % 2:
            one = np.pad(one, ((0, 0), (0, 1), (0, 0)))
        return (one[:, 0::2, :, None] + one[:, 1::2, None, :]).reshape(len(q), -1, CODES * CODES)


def pack(code: np.ndarray) -> np.ndarray:
    """Two four-bit codes in a byte."""
    if code.shape[1] % 2:
        code = np.pad(code, ((0, 0), (0, 1)))
    return (code[:, 0::2] * CODES + code[:, 1::2]).astype(np.uint8)


def parallel_weight(dim: int, share: float = FROM) -> float:
    """How many times parallel error counts more than other error, less one, where only products of at least
    ``share`` of a vector's norm matter and queries point anywhere alike.

    The ratio is (dim - 1) * (I(dim - 2) / I(dim) - 1), I(n) being the integral of sin^n from 0 to arccos(share). It
    is over 1 for any share over 0; its limit for many dimensions alone would fall below 1 for few.
    """
    if dim < 2:
        return 0.0
    edges = np.linspace(0, np.arccos(share), 4097)
    sines = np.sin((edges[1:] + edges[:-1]) / 2)
    return float((dim - 1) * ((sines ** (dim - 2)).sum() / (sines**dim).sum() - 1) - 1)


def train(x: np.ndarray, lists: int) -> Index:
    """x: a sample [row, dim]."""
    dim = x.shape[1]
    index = Index(_kmeans(x, lists), np.zeros((ceil(dim / 2), CODES, 2)), parallel_weight(dim))
    rest, way = index.parts(x, index.place(x))
    for j in range(rest.shape[1]):
        index.words[j] = _kmeans(np.ascontiguousarray(rest[:, j]), CODES, 8)
    code = index.code(rest, way)
    for _ in range(4):
        index.refine(rest, way, code)
        code = index.code(rest, way, code, 1)
    return index


def leading(score: np.ndarray, owner: np.ndarray | None, n: int) -> np.ndarray:
    """Where scores are at least the n-th largest; with owners (0, 1, ...), the n-th largest of the owners' best."""
    best = score
    if owner is not None:
        best = np.full(owner.max() + 1, -np.inf, score.dtype)
        np.maximum.at(best, owner, score)
    return np.flatnonzero(score >= np.partition(best, len(best) - n)[len(best) - n]) if len(best) > n else np.arange(len(score))


def _kth(ids: np.ndarray, score: np.ndarray, k: int) -> float:
    """The k-th largest of the ids' best scores; less than any score if there are fewer ids."""
    order = np.argsort(-score, kind="stable")
    first = np.sort(np.unique(ids[order], return_index=True)[1])
    return float(score[order[first[k - 1]]]) if len(first) >= k else -np.inf


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and vec (array of double) of rows that take part: an id, and no null or non-finite component, not all 0."""
    vec = F.col(vec_col).cast("array<double>")
    fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    return df.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).where(fine)


def search(df: DataFrame, query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (exact inner product, double) of the k nearest for each row
    where ``query`` (of the column vec_id) is true, among all rows but those with its own id.

    Vectors that are null, all zero, or hold a null or non-finite component take no part, nor do rows without an
    id, nor vectors of another length than most have. Ties go to smaller ids. Of equal vectors only the k + 1 with
    the smallest ids can be among the nearest, so only they are indexed. Repeated rows count once, and so does an id
    with several vectors, by its best score. Without vectors there are no rows.
    """
    spark = df.sparkSession
    ship(spark)
    names = "query_id long, rank int, vec_id long, score double"
    rows = usable(df, id_col, vec_col)
    lengths = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], names)
    rows = rows.where(F.size("vec") == lengths["d"])
    same = Window.partitionBy("vec").orderBy("vec_id")
    kept = rows.withColumn("n", F.dense_rank().over(same)).where(F.col("n") <= k + 1).drop("n").dropDuplicates(["vec_id", "vec"])
    fitted = kept.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec").collect()  # the bounded sample
    lists = int(min(MOST_LISTS, max(1, lengths["n"] // LIST)))
    index = train(np.array([r["vec"] for r in fitted]), lists)
    sent = spark.sparkContext.broadcast(index)

    def place(batches):
        ix = sent.value
        for batch in batches:
            x = _matrix(batch.column(1))
            at = ix.place(x)
            rest, way = ix.parts(x, at)
            code = ix.code(rest, way)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column(0), batch.column(1), pa.array([c.tobytes() for c in pack(code)], pa.binary()), pa.array(ix.missed(rest, code))], names=["list", "vec_id", "vec", "code", "missed"])

    coded = kept.mapInArrow(place, "list int, vec_id long, vec array<double>, code binary, missed double").checkpoint()
    asked = rows.where(query).dropDuplicates(["vec_id", "vec"]).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("q"))
    sizes = {r["list"]: r["n"] for r in coded.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row for each list
    parts = [ceil(sizes.get(i, 0) / PART) or 1 for i in range(lists)]
    fill = np.cumsum(np.concatenate([np.full(n, sizes.get(i, 0) / n) for i, n in enumerate(parts)]))
    block_of = (np.maximum(fill - 1e-6, 0) // BLOCK).astype(int)  # of each cell
    numbers = lambda x: F.split(F.lit(",".join(map(str, x))), ",").cast("array<int>")
    turns = max(1, ceil(asked.count() / QUERIES))
    part = F.pmod(F.xxhash64("vec_id"), numbers(parts)[F.col("list")]).cast("int")
    cells = coded.withColumn("cell", numbers(np.cumsum(parts) - parts)[F.col("list")] + part)
    blocks = cells.withColumn("block", numbers(block_of)[F.col("cell")]).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    queries = asked.withColumn("turn", F.pmod(F.xxhash64("query_id"), F.lit(turns)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(int(block_of[-1])))))
    found_schema = "query_id long, vec_id long, score double"

    def rank(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            ix = sent.value
            v, x = right.column("vec_id").to_numpy(), _matrix(right.column("vec"))
            code = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(len(v), -1)
            cell = right.column("cell").to_numpy()
            order = np.argsort(cell, kind="stable")
            members = []
            for at in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                some, owner = np.unique(v[at], return_inverse=True)
                members.append((at, np.ascontiguousarray(code[at].T), owner if len(some) < len(at) else None))
            ids, q = left.column("query_id").to_numpy(), _matrix(left.column("q"))
            lists, missed = right.column("list").to_numpy(), right.column("missed").to_numpy()
            longest = np.linalg.norm(x, axis=1).max()
            for low in range(0, len(ids), TOGETHER):
                some = q[low : low + TOGETHER]
                with np.errstate(over="ignore", invalid="ignore"):
                    table, base = ix.tables(some), some @ ix.centres.T
                every = None
                for i, (t, centre, length) in enumerate(zip(table, base, np.linalg.norm(some, axis=1), strict=True), low):
                    picked, bound = [], np.empty(len(v))
                    for at, c, owner in members:
                        # the centre's product is the same for the whole list, so it does not matter within a cell
                        with np.errstate(over="ignore", invalid="ignore"):
                            s = t[0][c[0]]
                            for j in range(1, len(c)):
                                s += t[j][c[j]]
                        bound[at] = s
                        picked.append(at[leading(s, owner, RERANK)])
                    near = np.concatenate(picked)
                    near = near[v[near] != ids[i]]
                    floor = _kth(v[near], (x[near] * q[i]).sum(1), k)
                    with np.errstate(over="ignore", invalid="ignore"):
                        bound += centre[lists] + length * (missed + 1e-5 * longest)  # tables are in single precision
                        near = np.flatnonzero(~(bound < floor) & (v != ids[i]))
                    if len(near) > MANY * len(v):
                        every = x @ some.T if every is None else every
                        exact = every[near, i - low]
                        floor = max(floor, _kth(v[near], exact, k))
                        near = near[~(exact < floor - 1e-9 * length * longest)]
                    exact = (x[near] * q[i]).sum(1)
                    best = np.lexsort((v[near], -exact))
                    best = best[np.sort(np.unique(v[near][best], return_index=True)[1])[:k]]  # of each id the best
                    out.append((np.full(len(best), ids[i]), v[near][best], exact[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.Table.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    keys = ["block", "turn"]
    found = queries.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(rank, found_schema).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Packing of documents into sequences by minimum bin slack.

A document's ids, with an end id, are cut into full pieces of ``capacity`` and one remainder. The remainders are a
multiset of at most capacity - 1 lengths, so its histogram is all that the driver needs, whatever the data. For each
window the longest length that remains is the seed, and a subset-sum dynamic programme over a bitset picks, within
the counts that remain, the lengths whose sum comes closest to the free room; the counts are found by going back over
the bitsets. The same filling is repeated while the counts last. A seed whose window would keep slack is set aside;
these few are laid end to end and cut at each capacity, and the last stretch is cut at powers of two, which need no
padding, so no sequence is padded at all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratamine.llm import bpe
from stratamine.llm.textvec import pieces
from stratamine.llm.tokens import encode_ids, two

PIECES = "doc_id long, text_key long, start long, length long, ids_crc32 long, doc_tokens long"
OUT = "doc_id long, text_key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Documents whose remainder is cut again are found through a broadcast up to this number of ids, else by a shuffle.
BROADCAST_IDS = 20_000


def best_filling(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length fill ``room`` as far as can be, longest lengths first."""
    reach, steps = 1, []
    whole = (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        if length > room or not counts[length]:
            continue
        left, k = min(counts[length], room // length), 1
        while left:  # 1, 2, 4 ... copies and the rest reach every number of copies
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & whole
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + k
            total -= length * k
    return used


@dataclass
class Plan:
    """Where the k-th piece of each length goes. Intervals of k by length, as arrays sorted by (length, low)."""

    capacity: int
    length: np.ndarray
    low: np.ndarray
    each: np.ndarray  # pieces of the length in one window
    first: np.ndarray  # id of the first window
    offset: np.ndarray
    used: np.ndarray  # by length: how many are in windows
    base: np.ndarray  # by length: where those set aside start in the last stretch
    tail: int  # ids in the last stretch
    tail_first: int  # id of its first sequence


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Windows for a histogram of piece lengths (1 to capacity)."""
    left = {n: c for n, c in histogram.items() if c and n < capacity}
    next_id = histogram.get(capacity, 0)
    used = np.zeros(capacity + 1, np.int64)
    rows, aside = [], {}
    while left:
        seed = max(left)
        left[seed] -= 1
        fill = best_filling(left, capacity - seed)
        left[seed] += 1
        if seed + sum(n * k for n, k in fill.items()) < capacity:
            aside[seed] = left.pop(seed)
            continue
        fill[seed] = fill.get(seed, 0) + 1
        times, at = min(left[n] // k for n, k in fill.items()), 0
        for n in sorted(fill, reverse=True):
            rows.append((n, int(used[n]), fill[n], next_id, at))
            at += n * fill[n]
            used[n] += fill[n] * times
            left[n] -= fill[n] * times
            if not left[n]:
                del left[n]
        next_id += times
    base, total = np.zeros(capacity + 1, np.int64), 0
    for n in sorted(aside, reverse=True):
        base[n] = total
        total += n * aside[n]
    used[capacity] = histogram.get(capacity, 0)
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(capacity, *table.T, used, base, total, next_id)


def tail_cuts(p: Plan) -> np.ndarray:
    """Bounds of the sequences of the last stretch that lie beyond its last full one."""
    at = p.tail - p.tail % p.capacity
    cuts = [at]
    while at < p.tail:
        at += 1 << ((p.tail - at).bit_length() - 1)
        cuts.append(at)
    return np.array(cuts, np.int64)


def assign(p: Plan, start: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, length, sequence id, offset, whole) of what each piece becomes; whole: it is not cut."""
    row = np.arange(len(length))
    full = length == p.capacity
    placed = ~full & (rank < p.used[length])
    aside = ~full & ~placed
    sequence, offset = np.where(full, rank, 0), np.zeros(len(length), np.int64)
    if placed.any():
        n, k = length[placed], rank[placed]
        key = p.length * (1 << 44) + p.low
        at = np.searchsorted(key, n * (1 << 44) + k, "right") - 1
        within = k - p.low[at]
        sequence[placed] = p.first[at] + within // p.each[at]
        offset[placed] = p.offset[at] + within % p.each[at] * n
    keep = ~aside
    parts = [(row[keep], start[keep], length[keep], sequence[keep], offset[keep], np.ones(int(keep.sum()), bool))]
    cuts, fulls = tail_cuts(p), p.tail // p.capacity
    for i in np.flatnonzero(aside).tolist():
        low = int(p.base[length[i]] + (rank[i] - p.used[length[i]]) * length[i])
        high, at, s = low + int(length[i]), low, int(start[i])
        while at < high:
            q = at // p.capacity
            if q < fulls:
                begin, end, number = q * p.capacity, (q + 1) * p.capacity, q
            else:
                j = int(np.searchsorted(cuts, at, "right")) - 1
                begin, end, number = int(cuts[j]), int(cuts[j + 1]), fulls + j
            n = min(high, end) - at
            parts.append(tuple(np.array([x]) for x in (i, s, n, p.tail_first + number, at - begin, n == length[i])))
            at, s = at + n, s + n
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def cut(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: full ones and the remainder. text_key tells equal ids with other texts apart."""
    docs = two(df, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    vocabulary = df.sparkSession.sparkContext.broadcast(bpe.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = bpe.worker_encoder(vocabulary, True, False)
        for batch in batches:
            for low, high, data, offsets in pieces(batch.column(2)):
                ids, edges = encode_ids(e, data, offsets, end_id)
                tokens = np.diff(edges)
                number = -(-tokens // capacity)
                row = np.repeat(np.arange(high - low), number)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)) * capacity
                length = np.minimum(capacity, tokens[row] - start)
                a = (edges[:-1][row] + start) * 4
                view = memoryview(ids.view(np.uint8))
                sums = [zlib.crc32(view[x:y]) for x, y in zip(a.tolist(), (a + length * 4).tolist(), strict=True)]
                take = pa.array(row + low)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(tokens[row])], schema=PIECE_SCHEMA)

    return docs.mapInArrow(run, PIECES)


PIECE_SCHEMA = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])
OUT_SCHEMA = pa.schema([(x.split()[0], pa.int64()) for x in OUT.split(", ")])


def pack(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs every document (a null text is empty: its end id alone) into sequences of at most ``capacity`` ids.

    Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Repeated rows
    are packed each; an empty table gives no rows. The pieces, some 50 bytes each, are written to the checkpoint
    folder, so texts are encoded once; only documents with a remainder in the last stretch are encoded again.
    """
    spark = df.sparkSession
    found = cut(df, path, capacity, end_id, id_col, text_col).checkpoint()
    # ranks within a length are dealt by (length, bucket), so a length that most documents have meets in no one task
    buckets = max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    found = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "text_key"), F.lit(buckets)))
    counts = found.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    p = spark.sparkContext.broadcast(plan(histogram, capacity))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).select("length", "bucket", "before")
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "text_key"))
    ranked = found.withColumn("k", within - 1).join(before, ["length", "bucket"]).select(*[x.split()[0] for x in PIECES.split(", ")], (F.col("k") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 6))
            row, start, length, sequence, offset, whole = assign(p.value, start, length, rank)
            take = pa.array(row)
            crc = pa.array(batch.column(4).take(take).to_numpy(zero_copy_only=False), pa.int64(), mask=~whole)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(start), pa.array(length), crc, batch.column(5).take(take), pa.array(sequence), pa.array(offset)], schema=OUT_SCHEMA)

    placed = ranked.mapInArrow(place, OUT)
    if not p.value.tail:
        return placed.drop("text_key")
    placed = placed.checkpoint()
    torn = placed.where("ids_crc32 is null")
    needed = torn.select("doc_id", "text_key").distinct()
    docs = two(df, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    few = needed.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    needed = (F.broadcast(needed) if few else needed).toDF("n_id", "n_key")
    texts = docs.join(needed, F.col("doc_id").eqNullSafe(F.col("n_id")) & (F.col("text_key") == F.col("n_key")), "left_semi").dropDuplicates(["doc_id", "text_key"])
    vocabulary = spark.sparkContext.broadcast(bpe.load(path))
    again = torn.drop("ids_crc32").join(texts.toDF("t_id", "t_key", "text"), F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("text_key") == F.col("t_key"))).select("text", "doc_id", "text_key", "start", "length", "doc_tokens", "sequence_id", "offset")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = bpe.worker_encoder(vocabulary, True, False)
        for batch in batches:
            made = []
            for low, high, data, offsets in pieces(batch.column(0)):
                ids, edges = encode_ids(e, data, offsets, end_id)
                a = edges[:-1] + batch.column(3).to_numpy()[low:high]
                b = a + batch.column(4).to_numpy()[low:high]
                made += [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            c = [batch.column(i) for i in range(1, 8)]
            yield pa.RecordBatch.from_arrays([*c[:4], pa.array(made, pa.int64()), *c[4:]], schema=OUT_SCHEMA)

    return placed.where("ids_crc32 is not null").unionByName(again.mapInArrow(sums, OUT)).drop("text_key")

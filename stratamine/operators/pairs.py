"""Pairs of keys that share members, met where their lists are: lists of members' keys are moved, pairs are not.

The keys of each member form a sorted list. Keys are cut into ranges (parts) of about as many pairs; a list goes once to
every part that holds one of its keys, from the first of them on. A part so has all that its keys share with larger ones,
and counts it in arrays of bounded size. What is moved is at most an entry for each pair, and much less where lists
touch few parts; the number of parts grows with the pairs, so the memory of a task doesn't grow with the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamine.functions.settle import dealt, settle
from stratamine.functions.ship import ship

#: Pairs of a part, on average; pairs that are counted at a time; entries of a batch; keys drawn for each part's bounds.
PAIRS, CHUNK, BATCH, DRAWN = 4_000_000, 1 << 20, 1 << 18, 32
MOMENTS = ["mx", "my", "mxy", "sx", "sy", "sxx", "syy", "tx", "ty", "sxy"]


def plain(column: pa.Array) -> np.ndarray:
    """Whole numbers as they are, others as objects that compare as Spark compares them."""
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False)
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def cut(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of entries whose sizes add up to ``most`` or little more."""
    ends = np.cumsum(sizes)
    low = 0
    while low < len(sizes):
        high = int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most)) + 1
        yield low, min(high, len(sizes))
        low = high


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def lists_of(taken: np.ndarray, sizes: np.ndarray, columns: list[pa.Array]) -> list[pa.ListArray]:
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    taken = pa.array(taken)
    return [pa.ListArray.from_arrays(offsets, c.take(taken)) for c in columns]


def lists(rows: DataFrame, key: str, member: str, values: list[str], parts: int | None = None) -> DataFrame:
    """keys (sorted) and the values beside them, of each member with several keys, settled. Rows are distinct (key,
    member); nulls of either meet nothing."""
    ship(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()
    picked = [F.col(key).alias("k"), F.col(member).alias("m"), *(F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values))]
    names = ["keys", *(f"v{i}" for i in range(len(values)))]

    def gather(batches):
        table = list(batches)
        if not table:
            return
        table = pa.Table.from_batches(table).combine_chunks()
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns]
        if not len(columns[0]):
            return
        k, m = columns.pop(0), columns.pop(0)
        at = plain(m) if pa.types.is_integer(m.type) else m.dictionary_encode().indices.to_numpy()
        rank = plain(k)
        rank = rank if rank.dtype != object else np.unique(rank, return_inverse=True)[1]
        order = np.lexsort((rank, at))
        at = at[order]
        starts = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        sizes = np.diff(np.append(starts, len(at)))
        starts, sizes = starts[sizes > 1], sizes[sizes > 1]
        for low, high in cut(sizes, BATCH):
            yield pa.RecordBatch.from_arrays(lists_of(order[spans(starts[low:high], sizes[low:high])], sizes[low:high], [k, *columns]), names=names)

    schema = ", ".join([f"keys array<{kind}>", *(f"{n} array<double>" for n in names[1:])])
    present = rows.where(F.col(key).isNotNull() & F.col(member).isNotNull()).select(*picked)
    return settle((dealt(present, parts, "m") if parts else present.repartition("m")).mapInArrow(gather, schema))


def bounds(made: DataFrame, pairs: int, parts: int) -> np.ndarray:
    """Keys that cut all into parts of about as many pairs, from keys drawn at even steps of the pairs. They decide who
    does the work, not what comes out."""
    step = max(1, pairs // (parts * DRAWN))
    kind = made.schema["keys"].dataType.elementType.simpleString()

    def draw(batches):
        done = 0
        for batch in batches:
            column = batch.column(0)
            sizes = np.diff(column.offsets.to_numpy())
            after = done + np.cumsum(np.repeat(np.cumsum(sizes), sizes) - np.arange(int(sizes.sum())) - 1)
            if len(after):
                taken = np.flatnonzero(np.diff(after // step, prepend=done // step))
                done = int(after[-1])
                yield pa.RecordBatch.from_arrays([column.flatten().take(pa.array(taken))], names=["k"])

    drawn = sorted(r["k"] for r in made.select("keys").mapInArrow(draw, f"k {kind}").collect())  # some for each part
    out = sorted({drawn[len(drawn) * i // parts] for i in range(1, parts)}) if drawn else []
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return np.array(out, np.int64)
    found = np.empty(len(out), object)
    found[:] = out
    return found


def _reduce(pair: np.ndarray, columns: dict[str, np.ndarray], at_least: int, whole: bool) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Sums of each pair's columns. Where no pair goes on beyond the chunk, those that cannot reach ``at_least`` are left
    out before they are sorted, by counts of hashes."""
    if whole and at_least > 1 and len(pair):
        hashed = ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)
        some = np.bincount(hashed, columns.get("both"), 1 << 22)[hashed] >= at_least
        pair, columns = pair[some], {n: c[some] for n, c in columns.items()}
    if not columns:
        pair = np.sort(pair)
        starts = np.flatnonzero(np.diff(pair, prepend=-1))
        return pair[starts], {"both": np.diff(np.append(starts, len(pair)))}
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    starts = np.flatnonzero(np.diff(pair, prepend=-1))
    sums = {n: np.add.reduceat(c[order], starts) if len(starts) else c[:0] for n, c in columns.items()}
    return pair[starts], sums if "both" in sums else sums | {"both": np.diff(np.append(starts, len(pair)))}


def _moments(x: np.ndarray, y: np.ndarray, nulls: bool) -> dict[str, np.ndarray]:
    """What sums up to moments: x and y each, and both together (m: how many are there)."""
    if not nulls:
        return {"sx": x, "sy": y, "sxx": x * x, "syy": y * y, "sxy": x * y}
    mx, my = ~np.isnan(x), ~np.isnan(y)
    x, y = np.where(mx, x, 0.0), np.where(my, y, 0.0)
    return {"mx": mx * 1.0, "my": my * 1.0, "mxy": (mx & my) * 1.0, "sx": x, "sy": y, "sxx": x * x, "syy": y * y, "tx": x * my, "ty": y * mx, "sxy": x * y}


def _spread(s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Covariance and the product of standard deviations."""
    both = s["both"].astype(float)
    mx, my, mxy = (s.get(n, both) for n in ("mx", "my", "mxy"))
    with np.errstate(invalid="ignore", divide="ignore"):
        deviation = np.sqrt(np.maximum(s["sxx"] / mx - (s["sx"] / mx) ** 2, 0)) * np.sqrt(np.maximum(s["syy"] / my - (s["sy"] / my) ** 2, 0))
        return (s["sxy"] - s.get("tx", s["sx"]) * s.get("ty", s["sy"]) / mxy) / mxy, deviation


def dealt_lists(rows: DataFrame, key: str, member: str, values: list[str], deal: int | None = None) -> tuple[DataFrame | None, int]:
    """The lists that each part needs and the number of parts: part, own (how many of a list's first keys are the part's
    and meet others), keys and values from the first of these on. None if no keys meet."""
    made = lists(rows, key, member, values, deal)
    n = F.size("keys").cast("long")
    pairs = made.agg(F.sum(F.floor(n * (n - 1) / 2))).first()[0] or 0
    if not pairs:
        return None, 0
    names = made.columns
    parts = ceil(pairs / PAIRS)
    edges = bounds(made, pairs, parts) if parts > 1 else np.zeros(0, np.int64)

    def send(batches):
        for batch in batches:
            columns = [c.flatten() for c in batch.columns]
            sizes = np.diff(batch.column(0).offsets.to_numpy())
            if not len(sizes):
                continue
            part = np.searchsorted(edges, plain(columns[0]), side="right")
            last = np.repeat(np.cumsum(sizes), sizes)  # where an entry's list ends
            start = np.diff(part, prepend=-1) != 0
            start[np.cumsum(sizes) - sizes] = True
            starts = np.flatnonzero(start)
            own = np.minimum(np.append(starts[1:], len(part)), last[starts] - 1) - starts  # the last key meets none
            starts, own = starts[own > 0], own[own > 0]
            for low, high in cut(last[starts] - starts, BATCH):
                some, long = starts[low:high], (last[starts] - starts)[low:high]
                yield pa.RecordBatch.from_arrays([pa.array(part[some], pa.int32()), pa.array(own[low:high], pa.int32()), *lists_of(spans(some, long), long, columns)], names=["part", "own", *names])

    kinds = (f"{f.name} {f.dataType.simpleString()}" for f in made.schema)
    return made.mapInArrow(send, ", ".join(["part int, own int", *kinds])), len(edges) + 1


def received(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[pa.Array]]]:
    """own, the lists' sizes, and their keys and values end to end, of a part; nothing if it is empty."""
    own, sizes, flat = [], [], []
    for batch in batches:
        own.append(batch.column(1).to_numpy())
        sizes.append(np.diff(batch.column(2).offsets.to_numpy()))
        flat.append([c.flatten() for c in batch.columns[2:]])
    if own:
        yield np.concatenate(own), np.concatenate(sizes), [pa.concat_arrays(c) for c in zip(*flat, strict=True)]


def sharing(rows: DataFrame, key: str, member: str, at_least: int = 1, fixed: list[str] = [], rating: str | None = None, keep: Callable | None = None, deal: int | None = None) -> DataFrame:  # noqa: B006
    """k1 < k2 with at least so many members in common and their number, both. Rows are distinct (key, member).

    ``fixed``: numbers that all rows of a key have alike; they come out as double, for each end (name1, name2).
    ``rating``: adds covar and deviation (the product of standard deviations) of this column over shared members; null
    ratings count in neither. ``keep`` takes arrays both, name1, name2 ... and says which pairs go on. ``deal``: partitions
    of the rows, if more than the session's number.
    """
    spark = rows.sparkSession
    values = [*fixed, *([rating] if rating else [])]
    kind = rows.schema[key].dataType.simpleString()
    ends = [f"{f}{i}" for f in fixed for i in (1, 2)]
    schema = ", ".join([f"k1 {kind}, k2 {kind}, both long", *(f"{e} double" for e in ends), *(["covar double, deviation double"] if rating else [])])
    sent, parts = dealt_lists(rows, key, member, values, deal)
    if sent is None:
        return spark.createDataFrame([], schema)

    def meet(batches):
        for own, sizes, (keys, *values) in received(batches):
            yield from count(own, sizes, keys, values)

    def count(own, sizes, keys, values):
        nulls = bool(rating) and values[-1].null_count > 0
        values = [c.to_numpy(zero_copy_only=False) for c in values]
        known, code = np.unique(plain(keys), return_inverse=True)
        first = np.zeros(len(known), np.int64)
        first[code] = np.arange(len(code))
        named = pa.array(known, keys.type)
        if rating:
            middle = np.round(np.nanmean(values[-1])) if np.isfinite(values[-1]).any() else 0.0
            rated = values.pop() - (middle if np.isfinite(middle) else 0.0)  # rounded, so whole ratings stay exact
        end = np.repeat(np.cumsum(sizes), own)
        at = spans(np.cumsum(sizes) - sizes, own)
        at, end = (lambda o: (at[o], end[o]))(np.argsort(code[at], kind="stable"))
        after = end - at - 1

        def result(pair, sums):
            some = sums["both"] >= at_least
            pair, sums = pair[some], {n: c[some] for n, c in sums.items()}
            one, two = pair // len(known), pair % len(known)
            for f, v in zip(fixed, values, strict=True):
                sums[f"{f}1"], sums[f"{f}2"] = v[first[one]], v[first[two]]
            if keep is not None:
                some = keep(sums)
                one, two, sums = one[some], two[some], {n: c[some] for n, c in sums.items()}
            out = [named.take(pa.array(one)), named.take(pa.array(two)), pa.array(sums["both"].astype(np.int64)), *(pa.array(sums[e]) for e in ends)]
            if rating:
                out += [pa.array(c, from_pandas=nulls) for c in _spread(sums)]
            return pa.RecordBatch.from_arrays(out, names=[*"k1 k2 both".split(), *ends, *(["covar", "deviation"] if rating else [])])

        held = None  # sums of a key that goes on in the next chunk
        for low, high in cut(after, CHUNK):
            here = code[at[low:high]]
            going = high < len(at) and code[at[high]] == here[-1]
            other = spans(at[low:high] + 1, after[low:high])
            pair = np.repeat(here, after[low:high]) * len(known) + code[other]
            columns = _moments(np.repeat(rated[at[low:high]], after[low:high]), rated[other], nulls) if rating else {}
            pair, sums = _reduce(pair, columns, at_least, held is None and not going)
            if held is not None:
                pair, sums = _reduce(np.concatenate([held[0], pair]), {n: np.concatenate([held[1][n], sums[n]]) for n in sums}, 1, False)
                held = None
            if going:
                stop = int(np.searchsorted(pair, here[-1] * len(known)))
                held = pair[stop:], {n: c[stop:] for n, c in sums.items()}
                pair, sums = pair[:stop], {n: c[:stop] for n, c in sums.items()}
            if len(pair):
                yield result(pair, sums)

    return sent.repartitionById(parts, "part").mapInArrow(meet, schema)

"""Frequent itemsets by growth: an item's baskets, from that item on, lie in one task, which grows sets from it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamine.functions.settle import dealt
from stratamine.operators import pairs
from stratamine.operators.pairs import cut, spans


def _count(code: np.ndarray, support: int) -> tuple[np.ndarray, np.ndarray]:
    code = np.sort(code)
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    n = np.diff(np.append(starts, len(code)))
    return code[starts[n >= support]], n[n >= support]


def grow(first: np.ndarray, ends: np.ndarray, code: np.ndarray, width: int, support: int, only: int | None):
    """Sets (codes [set, item], supports) of two items and more that begin with an item whose entries are ``first``, in
    lists that end at ``ends``. Every level extends the occurrences of frequent sets by what follows in their baskets."""
    place, end, sets, of = first, ends, np.unique(code[first])[:, None], np.unique(code[first], return_inverse=True)[1]
    while len(place) and (only is None or sets.shape[1] < only):
        after = end - place - 1
        following = spans(place + 1, after)
        pair = np.repeat(of, after) * width + code[following]
        good, n = _count(pair, support)
        if not len(good):
            return
        at = np.minimum(np.searchsorted(good, pair), len(good) - 1)
        some = good[at] == pair
        sets = np.concatenate([sets[good // width], (good % width)[:, None]], 1)
        if only is None or sets.shape[1] == only:
            yield sets, n
        place, end, of = following[some], np.repeat(end, after)[some], at[some]


def grown(rows: DataFrame, support: int, only: int | None = None, deal: int | None = None) -> DataFrame:
    """items (sorted array) and support of sets of ``only`` (two at least) items, or of every size."""
    rows = dealt(rows, deal, "item")
    singles = rows.groupBy("item").agg(F.count("*").alias("support")).where(F.col("support") >= support)
    kept = rows.join(singles.select("item"), "item", "left_semi")
    kind = rows.schema["item"].dataType.simpleString()
    schema = f"items array<{kind}>, support long"

    def mine(tables):
        for own, sizes, columns in tables:
            known, code = np.unique(pairs.plain(columns[0]), return_inverse=True)
            named = pa.array(known, columns[0].type)
            end = np.repeat(np.cumsum(sizes), own)
            at = spans(np.cumsum(sizes) - sizes, own)
            order = np.argsort(code[at], kind="stable")
            at, end = at[order], end[order]
            firsts = np.flatnonzero(np.diff(code[at], prepend=-1))
            entries = np.add.reduceat(end - at, firsts)
            bounds = np.append(firsts, len(at))
            for low, high in cut(entries, pairs.CHUNK):  # whole items
                some = slice(bounds[low], bounds[high])
                for sets, n in grow(at[some], end[some], code, len(known), support, only):
                    for a, b in cut(np.full(len(sets), sets.shape[1]), pairs.BATCH):
                        offsets = pa.array(np.arange(b - a + 1) * sets.shape[1], pa.int32())
                        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, named.take(pa.array(sets[a:b].ravel()))), pa.array(n[a:b]).cast(pa.int64())], names=["items", "support"])

    sent, parts = pairs.dealt_lists(kept, "item", "basket", [], deal)
    alone = singles.select(F.array("item").alias("items"), "support")
    if sent is None:
        return alone if only is None else rows.sparkSession.createDataFrame([], schema)
    more = sent.repartitionById(parts, "part").mapInArrow(lambda batches: mine(pairs.received(batches)), schema)
    return alone.unionByName(more) if only is None else more

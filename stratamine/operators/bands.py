"""Candidates of MinHash bands, checked where they meet.

The least value of a linear hash modulo a prime names the number that has it, so a band is a function and a number.
Numbers are cut into ranges (parts): a set goes, once and with its members, to every part that holds one of its bands,
and pairs that agree in a band are checked there. Parts grow in number with the members that are moved.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamine.functions.hashing import PRIME
from stratamine.functions.settle import dealt, settle
from stratamine.functions.ship import ship
from stratamine.operators.pairs import BATCH, CHUNK, DRAWN, PAIRS, cut, lists_of, plain, spans

#: Cells of the table in which members are looked up, members that are looked up at a time.
CELLS, LOOKED = 1 << 23, 1 << 21


def sets(rows: DataFrame, hashes: list[tuple[int, int, int]], deal: int | None = None) -> DataFrame:
    """k, e (members) and x: for each hash function the number of its least value. Rows are distinct k, e and the number
    x of e; settled."""
    ship(rows.sparkSession)
    kinds = [rows.schema[c].dataType.simpleString() for c in ("k", "e")]

    def gather(batches):
        table = list(batches)
        if not table:
            return
        k, e, x = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in pa.Table.from_batches(table).columns)
        if not len(k):
            return
        at = plain(k) if pa.types.is_integer(k.type) else k.dictionary_encode().indices.to_numpy()
        order = np.argsort(at, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) != 0]))
        sizes = np.diff(np.append(starts, len(at)))
        x = x.to_numpy()[order]
        for low, high in cut(sizes + len(hashes), BATCH):
            some, first = slice(starts[low], starts[low] + int(sizes[low:high].sum())), starts[low:high] - starts[low]
            least = [(np.minimum.reduceat((a * x[some] + b) % PRIME, first) - b) % PRIME * pow(a, -1, PRIME) % PRIME for _, a, b in hashes]
            number = pa.ListArray.from_arrays(pa.array(np.arange(high - low + 1) * len(hashes), pa.int32()), pa.array(np.stack(least, 1).ravel()))
            yield pa.RecordBatch.from_arrays([k.take(pa.array(order[starts[low:high]])), *lists_of(order[some], sizes[low:high], [e]), number], names=["k", "e", "x"])

    dealt_rows = dealt(rows, deal, "k") if deal else rows.repartition("k")
    return settle(dealt_rows.mapInArrow(gather, f"k {kinds[0]}, e array<{kinds[1]}>, x array<long>"))


def banded(rows: DataFrame, hashes: list[tuple[int, int, int]], least: float, min_overlap: int, columns: int, deal: int | None = None) -> DataFrame:
    """k1 < k2, n1, n2 and both of sets that agree in a band, from a Jaccard similarity and an overlap on. Pairs that meet
    in several parts come more than once."""
    spark = rows.sparkSession
    made = sets(rows, hashes, deal)
    kind = rows.schema["k"].dataType.simpleString()
    schema = f"k1 {kind}, k2 {kind}, n1 long, n2 long, both long"
    moved, many = made.agg(F.sum(F.size("e").cast("long") * F.size(F.array_distinct("x"))), F.count("*")).first()
    if not many:
        return spark.createDataFrame([], schema)
    parts = ceil(moved / PAIRS)
    step = max(1, many * len(hashes) // (parts * DRAWN))

    def draw(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).flatten().to_numpy()[step // 2 :: step])], names=["x"])

    drawn = sorted(r["x"] for r in made.select("x").mapInArrow(draw, "x long").collect()) if parts > 1 else []  # some for each part
    edges = np.unique(np.array([drawn[len(drawn) * i // parts] for i in range(1, parts)] if drawn else [], np.int64))
    parts = len(edges) + 1

    def send(batches):
        for batch in batches:
            k, e, numbers = batch.columns
            n = len(hashes)
            if not len(k):
                continue
            x = numbers.flatten().to_numpy()
            code = np.tile(np.arange(n, dtype=np.int64) << 31, len(k)) + x
            part = np.searchsorted(edges, x, side="right")
            who = np.repeat(np.arange(len(k)), n)
            order = np.lexsort((part, who))
            who, part, code = who[order], part[order], pa.array(code[order])
            starts = np.flatnonzero((np.diff(who, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
            count = np.diff(np.append(starts, len(who)))
            offsets, flat = e.offsets.to_numpy(), e.flatten()
            offsets = offsets - offsets[0]
            sizes = np.diff(offsets)[who[starts]]
            for low, high in cut(sizes, BATCH):
                some, at = starts[low:high], who[starts[low:high]]
                members = lists_of(spans(offsets[at], sizes[low:high]), sizes[low:high], [flat])
                yield pa.RecordBatch.from_arrays([pa.array(part[some], pa.int32()), k.take(pa.array(at)), *members, *lists_of(spans(some, count[low:high]), count[low:high], [code])], names=["part", "k", "e", "band"])

    def meet(batches):
        table = list(batches)
        if not table:
            return
        keys = pa.concat_arrays([b.column(1) for b in table])
        n = np.concatenate([np.diff(b.column(2).offsets.to_numpy()) for b in table])
        members = np.unique(plain(pa.concat_arrays([b.column(2).flatten() for b in table])), return_inverse=True)[1]
        each = np.concatenate([np.diff(b.column(3).offsets.to_numpy()) for b in table])
        code = np.concatenate([b.column(3).flatten().to_numpy() for b in table])
        rank = plain(keys)
        by = np.argsort(rank, kind="stable")  # sets in the order of keys, members in order within each
        starts = (np.cumsum(n) - n)[by]
        owner = np.repeat(np.arange(len(by)), n[by])
        members = members[spans(starts, n[by])]
        wide = int(members.max()) + 1
        held = np.sort(owner * wide + members)
        members = held % wide
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        who = np.repeat(place, each)
        n, keys = n[by], keys.take(pa.array(by))
        starts = np.cumsum(n) - n
        order = np.lexsort((who, code))
        who, code = who[order], code[order]
        fresh = np.flatnonzero(np.diff(code, prepend=-1) != 0)
        after = np.repeat(np.append(fresh[1:], len(code)), np.diff(np.append(fresh, len(code)))) - np.arange(len(code)) - 1
        at = np.argsort(who, kind="stable")
        across = min(columns, wide)
        rows_at_once = max(1, CELLS // across)
        for low, high in cut(after[at], CHUNK):
            here = at[low:high]
            pair = np.unique(np.repeat(who[here], after[here]) * len(n) + who[spans(here + 1, after[here])])
            one, two = pair // len(n), pair % len(n)
            need = np.maximum(float(min_overlap), least / (1 + least) * (n[one] + n[two]))
            some = np.minimum(n[one], n[two]) >= need
            one, two, need = one[some], two[some], need[some]
            for first, last in cut(n[two], LOOKED):
                a, b, least_both = one[first:last], two[first:last], need[first:last]
                both = np.zeros(len(a), np.int64)
                row = np.cumsum(np.diff(a, prepend=-1) != 0) - 1  # of the table, one for each first set
                for top in range(0, int(row[-1]) + 1, rows_at_once):
                    lo, hi = np.searchsorted(row, [top, top + rows_at_once])
                    own = np.unique(a[lo:hi])
                    filled = np.zeros((len(own), across), bool)
                    filled[np.repeat(np.arange(len(own)), n[own]), members[spans(starts[own], n[own])] % across] = True
                    seen = filled[np.repeat(row[lo:hi] - top, n[b[lo:hi]]), members[spans(starts[b[lo:hi]], n[b[lo:hi]])] % across]
                    both[lo:hi] = np.add.reduceat(seen.astype(np.int32), np.cumsum(n[b[lo:hi]]) - n[b[lo:hi]])
                maybe = both >= least_both
                a, b, least_both, both = a[maybe], b[maybe], least_both[maybe], both[maybe]
                if across < wide and len(a):  # members that share a column were counted too
                    asked = np.repeat(a, n[b]) * wide + members[spans(starts[b], n[b])]
                    there = held[np.minimum(np.searchsorted(held, asked), len(held) - 1)] == asked
                    both = np.add.reduceat(there.astype(np.int64), np.cumsum(n[b]) - n[b])
                    maybe = both >= least_both
                    a, b, both = a[maybe], b[maybe], both[maybe]
                if len(a):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(a)), keys.take(pa.array(b)), pa.array(n[a]).cast(pa.int64()), pa.array(n[b]).cast(pa.int64()), pa.array(both).cast(pa.int64())], names=["k1", "k2", "n1", "n2", "both"])

    sent = made.mapInArrow(send, f"part int, k {kind}, e {made.schema['e'].dataType.simpleString()}, band array<long>")
    return sent.repartitionById(parts, "part").mapInArrow(meet, schema)

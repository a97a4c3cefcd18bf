"""Size-aware Jaccard join of documents' sets of word n-grams, exact.

Small sets are light: two of sizes s and t link only if they share c(s, t) members, so each set enumerates its
subsets of the few sizes c that a partner can call for. A list of equal subsets needs no check: its smallest set
links with every set that any other of the list could link with.

Large sets are heavy: they scan inverted lists of their members. Two that link share one of the s - ceil(s * num / den)
+ 1 members that come first in any order common to all sets; the order is by the number of sets that hold a member,
counted over all documents, so what thousands share comes last and is rarely looked up, and members of one set alone
need no list. Sets that share a list form a family.

The boundary is the size up to which enumerating costs less than scanning: sizes are counted, and so are the lists of
one in 64 members of the small sets. Within a family all pairs that aren't connected yet are compared exactly, in
blocks of bounded size; only edges that connect come out, and no pair is a row. Equal sets are one from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamine.llm.graph import components, hub_join
from stratamine.llm.ship import settled
from stratamine.llm.textvec import U64, combine, concat_ranges, keys_of, low_bytes, mix, pieces, words
from stratamine.llm.tokens import two

#: Sets of a block; a family of more is compared by pairs of blocks.
BLOCK = 256
#: Members of a large family that stand in every one of its blocks, to connect them.
ANCHORS = 4
#: Costs against that of an enumerated subset: to count a member, and to meet another set in a list.
COUNT_COST, MEET_COST = 0.25, 1.0
#: A set that has more subsets than this is heavy whatever the costs, which bounds a worker's memory.
MOST_SUBSETS = 4096
#: One of so many members is taken to estimate the lengths of lists.
SAMPLED = 64
#: Sets in a list, beyond which it is dealt into parts that its key ties together.
LONG_LIST = 100_000
#: Bytes of text in a block whose members are counted together, and members in a range of their hashes.
BLOCK_BYTES, RANGE = 6 << 20, 1 << 20
KEY_BYTES = 6  # of a member within its range
#: Up to so many members of families their texts are found through a broadcast of ids, else by a shuffle.
BROADCAST_IDS = 200_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's runs of k words, in order by text and hash, and the bounds of each text's."""
    w, row = words(data, offsets)
    n = len(offsets) - 1
    edges = np.searchsorted(row, np.arange(n + 1))
    size = np.diff(edges)
    value, owner = [], []
    if len(w) >= k:
        h = w[: len(w) - k + 1]
        for j in range(1, k):
            h = combine(h, w[j : len(w) - k + 1 + j])
        inside = row[: len(row) - k + 1] == row[k - 1 :]
        value.append(h[inside])
        owner.append(row[: len(row) - k + 1][inside])
    for length in range(1, k):  # texts with fewer words: all of them as one
        short = np.flatnonzero(size == length)
        if len(short):
            h = w[edges[short]]
            for j in range(1, length):
                h = combine(h, w[edges[short] + j])
            value.append(h)
            owner.append(short)
    if not value:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    value, owner = np.concatenate(value), np.concatenate(owner)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[keep], np.searchsorted(owner[keep], np.arange(n + 1))


def signatures(value: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each whole set."""
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(mix(value), out=total[1:])
    return mix(total[edges[1:]] - total[edges[:-1]] + np.diff(edges).astype(np.uint64) * U64(0x9FB21C651E98DF25))


class Rule:
    """Two sets link if den * intersection >= num * union. Sizes, subsets and prefixes follow."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.most = 0  # the largest size that can be light
        while self.subsets(self.most + 1) <= MOST_SUBSETS:
            self.most += 1

    def overlap(self, s: int, t: int) -> int:
        return -(-self.num * (s + t) // (self.num + self.den))

    def partner_sizes(self, s: int) -> range:
        return range(max(1, -(-self.num * s // self.den)), self.den * s // self.num + 1)

    def subset_sizes(self, s: int) -> list[int]:
        return sorted({c for t in self.partner_sizes(s) if (c := self.overlap(s, t)) <= min(s, t)})

    def subsets(self, s: int) -> int:
        return sum(comb(s, c) for c in self.subset_sizes(s))

    def lowest(self, boundary: int) -> int:
        """The least size with a partner above the boundary; from there on sets are heavy, or both."""
        return max(1, -(-self.num * (boundary + 1) // self.den))

    def prefix(self, s):
        """Members of which two linked sets share one, if the larger or equal of them has size s or more."""
        return s + self.num * s // -self.den + 1

    def boundary(self, histogram: dict[int, int], length: float) -> int:
        """The light sizes' upper end that costs least, for so many sets of each size and lists of that mean length."""
        heavy = lambda s: s * COUNT_COST + self.prefix(s) * (1 + MEET_COST * (length - 1))
        cost = lambda x: sum(c * ((s <= x) * self.subsets(s) + (s >= self.lowest(x)) * heavy(s)) for s, c in histogram.items())
        return min(range(self.most + 1), key=lambda x: (cost(x), x))

    def linked(self, both: np.ndarray, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        return self.den * both >= self.num * (s + t - both)


def subset_entries(value: np.ndarray, edges: np.ndarray, r: Rule, boundary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, limit) of the subsets of the light sets; limit: the largest sum of sizes that links for sure."""
    size = np.diff(edges)
    out_row, out_key, out_limit = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    spread = mix(value)
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(spread, out=total[1:])
    for s in range(1, boundary + 1):
        own = np.flatnonzero(size == s)
        if not len(own):
            continue
        members = spread[edges[own][:, None] + np.arange(s)]
        whole = total[edges[own] + s] - total[edges[own]]
        for c in r.subset_sizes(s):
            without = np.array(list(combinations(range(s), s - c)), np.int64).reshape(comb(s, c), s - c)
            sums = whole[:, None] - members[:, without].sum(2, dtype=np.uint64)
            out_row.append(np.repeat(own, sums.shape[1]))
            out_key.append(mix(sums.ravel() + U64(c * 0xC2B2AE3D27D4EB4F % 2**64)))
            out_limit.append(np.full(sums.size, (r.num + r.den) * c // r.num))
    return np.concatenate(out_row), np.concatenate(out_key), np.concatenate(out_limit)


def rarity(count: np.ndarray) -> np.ndarray:
    """Counts of sets in a byte: exact below 128, then in quarters of a doubling. It never falls as the count grows."""
    high = 128 + np.floor(4 * np.log2(np.maximum(count, 128) / 128))
    return np.where(count < 128, count, np.minimum(high, 255)).astype(np.uint8)


def counts_of(rare: np.ndarray) -> np.ndarray:
    """The counts that ``rarity`` stands for, from below."""
    return np.where(rare < 128, rare, 128 * 2.0 ** ((rare.astype(float) - 128) / 4))


def prefix_entries(value: np.ndarray, edges: np.ndarray, rare: np.ndarray, r: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, sets) of the members whose lists each set scans: the rarest first, ties by hash, none that it holds
    alone; sets: how many hold the member."""
    size = np.diff(edges)
    own = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((value, rare, own))
    first = np.arange(len(value)) - np.repeat(edges[:-1], size) < np.repeat(r.prefix(size), size)
    kept = order[first & (rare[order] > 1)]
    return own[kept], combine(np.full(len(kept), 1, np.uint64), value[kept]), counts_of(rare[kept])


def _batch(schema: str, *columns) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def _edges_of(label: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each member to the first of its label."""
    away = label != np.arange(len(label))
    return ids[away], ids[label[away]]


def connect(sets: list[np.ndarray], r: Rule, label: np.ndarray) -> np.ndarray:
    """Labels (the least index) after all pairs are compared whose labels differ; sets are sorted and distinct.

    A pair whose labels differ has a side outside the most frequent label, so only those sets meet all the others.
    Members that a single set holds are in no intersection, and members that the same sets hold count as one with a
    weight.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets])
    rest = np.flatnonzero(label != np.bincount(label).argmax()) if n else np.zeros(0, np.int64)
    if not len(rest) or not size.any():
        return label
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    _, column = np.unique(flat, return_inverse=True)
    within = np.zeros(n, bool)
    within[rest] = True
    met = np.bincount(column[within[owner]], minlength=column.max() + 1)
    shared = (np.bincount(column) > 1) & (met > 0)
    keep = shared[column]
    column, owner = column[keep], owner[keep]
    near = np.zeros((len(rest), n), bool)
    if len(column):
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        begin = np.flatnonzero(np.r_[True, column[1:] != column[:-1]])
        held = np.add.reduceat(mix(owner.astype(np.uint64) + U64(1)), begin)
        _, first, weight = np.unique(held, return_index=True, return_counts=True)
        count = np.diff(np.r_[begin, len(column)])
        both = np.zeros((len(rest), n), np.float32)
        for low in range(0, len(first), 8192):
            some = first[low : low + 8192]
            grid = np.zeros((n, len(some)), np.float32)
            grid[owner[concat_ranges(begin[some], count[some])], np.repeat(np.arange(len(some)), count[some])] = 1
            both += (grid[rest] * weight[low : low + 8192].astype(np.float32)) @ grid.T
        near = r.linked(both.astype(np.int64), size[rest][:, None], size[None, :]) & (size[rest] > 0)[:, None] & (size > 0)
    group, now = label, label
    while True:
        new = np.minimum(now, np.where(near, now[rest][:, None], n).min(0))
        new[rest] = np.minimum(new[rest], np.where(near, now[None, :], n).min(1))
        least = np.full(n, n)
        np.minimum.at(least, group, new)
        new = least[group]
        if (new == now).all():
            return now
        now = new


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of rows with equal values in the first ``keys`` columns, from batches sorted by these."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        rest = t if rest is None else pa.concat_tables([rest, t])
        at = rest.select(list(range(keys)))
        change = np.zeros(rest.num_rows - 1, bool)
        for c in at.columns:
            v = c.to_numpy()
            change |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield rest.slice(a, b - a)
        rest = rest.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def _sets(column: pa.ChunkedArray, k: int) -> list[np.ndarray]:
    out = []
    for _, _, data, offsets in pieces(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column):
        value, edges = shingle_sets(data, offsets, k)
        out += [value[edges[i] : edges[i + 1]] for i in range(len(edges) - 1)]
    return out


DIGEST = "doc_id long, n_shingles long, n_bytes long, signature long, sample array<long>"
#: key: of a list; bound: the largest sum of sizes that links for sure, 0 where pairs must be compared, -1 in a part of
#: a long list, of which base is the key.
ENTRY = "key long, size int, doc_id long, bound int, base long"


def join(df: DataFrame, words: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every row.

    A text's set holds its distinct runs of ``words`` words, or all its words as one run if it has fewer; a text
    without words, empty or null, has none and links with nothing. Two link if den * intersection >= num * union.
    Rows with one id are one node, whatever their texts; rows without an id link with nothing and have no component.
    An empty table gives no rows. Nothing is dropped, sampled or capped.
    """
    spark = df.sparkSession
    r = Rule(num, den)
    docs = two(df, id_col, text_col)

    def digest(batches):
        for batch in batches:
            for low, high, data, offsets in pieces(batch.column(1)):
                value, edges = shingle_sets(data, offsets, words)
                size = np.diff(edges)
                taken = np.flatnonzero((mix(value) % U64(SAMPLED) == 0) & np.repeat(size <= r.most, size))
                sample = pa.ListArray.from_arrays(np.searchsorted(taken, edges).astype(np.int32), value[taken].view(np.int64))
                yield _batch(DIGEST, batch.column(0).slice(low, high - low), size, np.diff(offsets), signatures(value, edges).view(np.int64), sample)

    digests = settled(docs.mapInArrow(digest, DIGEST))
    rows, nbytes = digests.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    some = digests.where("n_shingles > 0 and doc_id is not null")
    sets = settled(some.groupBy("signature").agg(F.min("doc_id").alias("first"), F.min("n_shingles").alias("size"), F.count("*").alias("n")))
    repeated = digests.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    again = bool(repeated.limit(1).count())
    if again:
        docs, repeated = docs.dropDuplicates(["doc_id", "text"]), settled(repeated)

    histogram = {x["size"]: x["n"] for x in sets.where(F.col("size") <= r.most).groupBy("size").agg(F.count("*").alias("n")).collect()}  # a row for each small size
    lists = some.select("signature", F.explode("sample").alias("key")).distinct().groupBy("key").agg(F.count("*").cast("double").alias("n"))
    met, all_members = lists.agg(F.sum(F.col("n") * F.col("n")), F.sum("n")).first()
    boundary = r.boundary(histogram, met / all_members if all_members else 1.0)
    lowest = r.lowest(boundary)
    members = sets.where(F.col("size") >= lowest).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    blocks, parts = max(1, ceil(nbytes / BLOCK_BYTES)), max(1, ceil(members / RANGE))

    block_of = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")
    dealt = docs.where("doc_id is not null").select(block_of.alias("block"), "doc_id", "text").groupBy("block")
    wanted = sets.select(F.col("first").alias("doc_id")).distinct().select(block_of.alias("block"), "doc_id", F.lit(None).cast("int").alias("part"), F.lit(None).cast("binary").alias("rare"))

    def distinct_sets(docs: pa.Table, told: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, members and bounds of a block's distinct sets that aren't empty, in the same order every time."""
        t = docs.filter(pc.is_in(docs.column("doc_id"), told.column("doc_id").combine_chunks().drop_null()))
        ids, value, size, mark = t.column("doc_id").to_numpy(), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for _, _, data, offsets in pieces(t.column("text")):
            v, e = shingle_sets(data, offsets, words)
            value.append(v), size.append(np.diff(e)), mark.append(signatures(v, e))
        value, size, mark = np.concatenate(value), np.concatenate(size), np.concatenate(mark)
        order = np.lexsort((ids, mark))
        order = order[np.r_[True, mark[order][1:] != mark[order][:-1]][: len(order)] & (size[order] > 0)]
        begin = np.cumsum(size) - size
        return ids[order], value[concat_ranges(begin[order], size[order])], np.r_[0, np.cumsum(size[order])]

    def heavy(value: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        large = np.flatnonzero(np.diff(edges) >= lowest)
        size = np.diff(edges)[large]
        return large, value[concat_ranges(edges[large], size)], np.r_[0, np.cumsum(size)]

    def ask(docs: pa.Table, told: pa.Table) -> pa.Table:
        _, value, edges = distinct_sets(docs, told)
        keys, counts = np.unique(heavy(value, edges)[1], return_counts=True)
        part = ((keys >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, np.int64)
        spans = list(zip(cut[:-1], cut[1:], strict=True))
        return pa.table(
            {
                "part": pa.array([int(part[a]) for a, _ in spans], pa.int32()),
                "block": pa.array([docs.column("block")[0].as_py() for _ in spans], pa.int32()),
                "keys": pa.array([low_bytes(keys[a:b], KEY_BYTES) for a, b in spans], pa.binary()),
                "counts": pa.array([counts[a:b].astype("<u4").tobytes() for a, b in spans], pa.binary()),
            }
        )

    def tell(t: pa.Table) -> pa.Table:
        raw = [keys_of(x, KEY_BYTES) for x in t.column("keys").to_pylist()]
        bounds = np.cumsum([0, *map(len, raw)])
        keys, where = np.unique(np.concatenate(raw), return_inverse=True)
        rare = rarity(np.bincount(where, np.concatenate([np.frombuffer(x, "<u4") for x in t.column("counts").to_pylist()]), len(keys)))[where]
        return pa.table({"block": t.column("block"), "doc_id": pa.nulls(len(raw), pa.int64()), "part": t.column("part"), "rare": pa.array([rare[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())})

    def enter(docs: pa.Table, told: pa.Table) -> pa.Table:
        ids, value, edges = distinct_sets(docs, told)
        size = np.diff(edges)
        row, key, bound = subset_entries(value, edges, r, boundary)
        large, value, edges = heavy(value, edges)
        answers = sorted((p, x) for p, x in zip(told.column("part").to_pylist(), told.column("rare").to_pylist(), strict=True) if p is not None)
        rare = np.frombuffer(b"".join(x for _, x in answers), np.uint8)[np.unique(value, return_inverse=True)[1]]
        own, base, held = prefix_entries(value, edges, rare, r)
        shares = np.ceil(held / LONG_LIST).astype(np.uint64)
        long = shares > 1
        share = mix(ids[large[own]].view(np.uint64)) % np.maximum(shares, 1)
        row, key = np.r_[row, large[own]], np.r_[key, np.where(long, combine(base, share), base)]
        bound, base = np.r_[bound, np.where(long, -1, 0)], np.r_[np.zeros(len(bound), np.uint64), np.where(long, base, 0)]
        return pa.table({"key": key.view(np.int64), "size": size[row].astype(np.int32), "doc_id": ids[row], "bound": bound.astype(np.int32), "base": base.view(np.int64)})

    told_schema = "block int, doc_id long, part int, rare binary"
    answers = settled(dealt.cogroup(wanted.groupBy("block")).applyInArrow(ask, "part int, block int, keys binary, counts binary").groupBy("part").applyInArrow(tell, told_schema))
    entries = dealt.cogroup(wanted.unionByName(answers).groupBy("block")).applyInArrow(enter, ENTRY)

    pair_schema = "a long, b long, sure boolean"

    def scan(batches):
        last = None  # key, size and id of the first of a list's run, and the size of its last, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            key, size, ids, bound, base = (batch.column(i).to_numpy() for i in range(5))
            before_key, before_size = np.r_[last[0] if last else ~key[0], key[:-1]], np.r_[last[3] if last else 0, size[:-1]]
            # sizes rise within a list; where they leap, no set before links with one after
            begin = (key != before_key) | ((bound == 0) & (num * size.astype(np.int64) > den * before_size.astype(np.int64)))
            head = np.maximum.accumulate(np.where(begin, np.arange(len(key)), -1))
            first_size = np.where(head >= 0, size[head], last[1] if last else 0)
            first_id = np.where(head >= 0, ids[head], last[2] if last else 0)
            last = (key[-1], first_size[-1], first_id[-1], size[-1])
            sure = bound > 0
            keep = (ids != first_id) & (~sure | (size + first_size <= bound))
            part = begin & (bound < 0)  # the first of a part stands by the list's key
            if keep.any() or part.any():
                pairs = np.unique(np.stack([np.r_[ids[keep], ids[part]], np.r_[first_id[keep], base[part]], np.r_[sure[keep], sure[part]].astype(np.int64)]), axis=1)
                yield _batch(pair_schema, pairs[0], pairs[1], pairs[2].astype(bool))

    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt_lists = entries.repartition(n, "key").sortWithinPartitions("key", "size", "doc_id")
    pairs = settled(dealt_lists.mapInArrow(scan, pair_schema).distinct())
    links = pairs.where("sure").select("a", "b")
    families = components(pairs.where("not sure").select("a", "b"))
    sizes = families.groupBy("component").agg(F.count("*").alias("n"))
    families = settled(hub_join(families, sizes, "component", rows).withColumnRenamed("n", "members"))
    if families.limit(1).count():
        links = links.unionByName(_within(docs, families, words, r, n))
    first = sets.select("signature", F.col("first").alias("b"), "n")
    if again:  # ids with several texts tie their sets together
        tied = hub_join(some, repeated.select("doc_id", F.col("n").alias("many")), "doc_id", rows, count="many").drop("many")
        links = links.unionByName(hub_join(tied, first, "signature", rows).select(F.col("doc_id").alias("a"), "b").where("a <> b").distinct())
    found = components(links)
    label = first.join(found.select(F.col("id").alias("b"), "component"), "b", "left").select("signature", "n", F.coalesce("component", "b").alias("component"))
    made = hub_join(some, label, "signature", rows).select("doc_id", "n_shingles", "component")
    none = digests.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    if again:  # a text without words has the component of its id's other texts
        by_id = repeated.join(found.select(F.col("id").alias("doc_id"), F.col("component").alias("of_id")), "doc_id")
        of_none = hub_join(none.where("doc_id is not null"), by_id, "doc_id", rows, how="left")
        none = of_none.select("doc_id", "n_shingles", F.coalesce("of_id", "doc_id").alias("component")).unionByName(none.where("doc_id is null"))
    return made.unionByName(none).withColumnRenamed("component", "component_id")


def _within(docs: DataFrame, families: DataFrame, words: int, r: Rule, n: int) -> DataFrame:
    """Edges (a, b) that connect the linked members of each family. families: id, component, members.

    Only routes, a few numbers each, are kept between the steps; texts are read anew and travel once for each route.
    """
    total = families.count()
    few = total <= BROADCAST_IDS
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    named = families.select(F.col("id").alias("doc_id"), F.col("component").alias("family"), blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    edge_schema = "a long, b long"
    sort = ["family", "i", "j"]

    def compare(batches):
        for t in _runs(batches, 3):
            ids, sets = t.column(3).to_numpy(), _sets(t.column(5), words)
            _, label = np.unique(t.column(4).to_numpy(), return_inverse=True)
            first = np.full(label.max() + 1, len(ids))
            np.minimum.at(first, label, np.arange(len(ids)))
            a, b = _edges_of(connect(sets, r, first[label]), ids)
            if len(a):
                yield _batch(edge_schema, a, b)

    def compared(routes: DataFrame) -> DataFrame:
        texts = docs.join(F.broadcast(routes) if few else routes, "doc_id").select(*sort, "doc_id", "known", "text")
        return settled(texts.repartition(n, *sort).sortWithinPartitions(*sort, "doc_id").mapInArrow(compare, edge_schema))

    # each block by itself; in families of several blocks with a few members that stand in all of them
    route = lambda rows, i, j, known: rows.select("family", F.expr(i).alias("i"), F.expr(j).alias("j"), "doc_id", F.col(known).alias("known"))
    own, large = route(named, "block", "block", "doc_id"), named.where("blocks > 1")
    if not large.limit(1).count():
        return compared(own)
    anchors = large.groupBy("family", "blocks").agg(F.expr(f"slice(array_sort(collect_set(if(pmod(xxhash64(doc_id), blocks) = 0, doc_id, null))), 1, {ANCHORS})").alias("best"))
    spread = anchors.select("family", "blocks", F.explode("best").alias("doc_id")).withColumn("at", F.expr("explode(sequence(1, blocks - 1))"))
    edges = compared(own.unionByName(route(spread, "at", "at", "doc_id")))
    # members outside the most frequent component of a large family, dealt into blocks anew, meet each of its blocks
    known = components(edges).select(F.col("id").alias("doc_id"), "component")
    large = settled(large.join(known, "doc_id", "left").select("family", "blocks", "block", "doc_id", F.coalesce("component", "doc_id").alias("known")))
    tally = large.groupBy("family", "known").agg(F.count("*").alias("c"))
    left_open = tally.groupBy("family").agg(F.max_by("known", F.struct("c", "known")).alias("main"), F.sum("c").alias("n"), (F.sum("c") - F.max("c")).alias("rest")).where("rest > 0")
    members = hub_join(large, left_open, "family", total).withColumn("others", F.ceil(F.col("rest") / BLOCK).cast("int"))
    outside = members.where("known <> main").withColumn("other", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("others")).cast("int"))
    crossing = route(outside.withColumn("at", F.expr("explode(sequence(0, blocks - 1))")), "other", "at", "known")
    crossing = crossing.unionByName(route(members.withColumn("at", F.expr("explode(sequence(0, others - 1))")), "at", "block", "known"))
    return edges.unionByName(compared(crossing.distinct()))

"""Language-model scores by deleted interpolation.

The probability of a token is a mixture of the maximum-likelihood estimates of all orders up to ``order`` and of a
uniform one. The weights depend on how often the longest context was seen, by powers of two, and are learned by
expectation-maximisation: a part of the training documents is deleted from the counts, and the weights are those
that make it likeliest under the counts of the rest. Scores use the counts of all training documents.

Documents are dealt into blocks of bounded size by a hash; their texts travel compressed, and rows that repeat an id
and a text travel from a batch once, with their number. A block sends its distinct n-grams, packed by the range of
their hashes, with their counts in its training documents; for each range they are merged; and each block gets the
corpus counts of its own n-grams back, in its own order, so answers hold no keys. One n-gram is thus one entry for each
block that holds it, however often it occurs. Blocks and ranges grow in number with the input, not in size; a row holds
an n-gram at least, so there are never more rows than entries. For the weights the deleted blocks' tokens are summed up
by their context's bucket and their estimates on a logarithmic grid, a table of bounded size; the driver sees only that.
"""

from __future__ import annotations

import zlib
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamine.llm.ship import settled
from stratamine.llm.textvec import U64, buffers, combine, keys_of, low_bytes, pieces, words
from stratamine.llm.tokens import two

END = U64(0x5851F42D4C957F2D)
START = U64(0x14057B7EF767814F)
#: Bytes of a key within its range. Tokens are counted exactly; of a range's million longer n-grams one may be taken
#: for another, which its estimate can bear.
KEY_BYTES = {1: 7, 2: 5, 3: 5}
BUCKETS = 24
GRID = 2  # steps of the logarithmic grid in a factor of two
NEVER = -(2**15)


def tokens(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end, where each text starts among them, and how many it has."""
    parts, sizes = [], []
    for _, _, data, offsets in pieces(texts):
        w, row = words(data, offsets)
        n = len(offsets) - 1
        count = np.bincount(row, minlength=n)
        out = np.full(len(w) + n, END)
        out[np.arange(len(w)) + row] = w
        parts.append(out)
        sizes.append(count + 1)
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(size) - size, size


def grams(token: np.ndarray, begins: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order, the hash of the n-gram that ends at each token; those at a text's start begin before it."""
    out, start = [token], START
    for _ in range(order - 1):
        before = np.empty_like(token)
        before[1:] = out[-1][:-1]
        before[begins] = start
        out.append(combine(before, token))
        start = combine(np.array([start]), np.array([START]))[0]
    return out


def pack(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs, after that width."""
    width = 1 if not len(x) or x.max() < 1 << 8 else 2 if x.max() < 1 << 16 else 4 if x.max() < 1 << 32 else 8
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def pack_small(x: np.ndarray) -> bytes:
    """As ``pack``, compressed: counts of one corpus are mostly ones."""
    return zlib.compress(pack(x), 1)


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


DEALT = "block int, ids binary, held binary, times binary, sizes binary, texts binary"
ASK = "kind int, part int, block int, keys binary, counts binary"
TELL = "kind int, part int, block int, whole binary, main binary, main_tokens long, main_types long, all_tokens long, all_types long"


def _key_bytes(kind: int) -> int:
    return KEY_BYTES.get(kind, 5)


def _deal(batches):
    """Rows (block, doc_id, held_out, text), one for each block and batch, with texts compressed and equal rows as one."""
    codec = pa.Codec("zstd", 1)
    for batch in batches:
        t = pa.Table.from_batches([batch]).group_by(["block", "doc_id", "held_out", "text"]).aggregate([([], "count_all")]).sort_by("block")
        block = t.column("block").to_numpy()
        cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else np.zeros(1, np.int64)
        id_col, rows = t.column("doc_id"), []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            own = t.slice(a, b - a)
            data, offsets = buffers(own.column("text"))
            ids = id_col.slice(a, b - a)
            known = ids.is_valid().to_numpy()
            held = own.column("held_out").to_numpy().astype(np.uint8) | (known.astype(np.uint8) << 1)
            raw = data[offsets[0] : offsets[-1]].tobytes()
            rows.append((int(block[a]), ids.fill_null(0).to_numpy().astype("<i8").tobytes(), held.tobytes(), own.column("count_all").to_numpy().astype("<i8").tobytes(), np.diff(offsets).astype("<i8").tobytes(), codec.compress(raw, asbytes=True)))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.binary() if i else pa.int32()) for i in range(6)], names=[x.split()[0] for x in DEALT.split(", ")])


def _documents(t: pa.Table) -> pa.Table:
    """doc_id, held_out, times and text of a block as it was dealt, equal rows as one, in an order of their own."""
    codec, parts = pa.Codec("zstd"), []
    for ids, held, times, sizes, texts in zip(*(t.column(c).to_pylist() for c in ("ids", "held", "times", "sizes", "texts")), strict=True):
        size, flag = np.frombuffer(sizes, "<i8"), np.frombuffer(held, np.uint8)
        raw = codec.decompress(texts, int(size.sum())) if len(size) and size.sum() else pa.py_buffer(b"")
        offsets = np.r_[0, np.cumsum(size)].astype(np.int32)
        text = pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), raw)
        parts.append(pa.table({"doc_id": pa.array(np.frombuffer(ids, "<i8"), mask=flag < 2), "held_out": flag % 2 == 1, "times": np.frombuffer(times, "<i8"), "text": text}))
    return pa.concat_tables(parts).group_by(["doc_id", "held_out", "text"]).aggregate([("times", "sum")]).rename_columns(["doc_id", "held_out", "text", "times"])


def learn(spread: dict[int, tuple[np.ndarray, np.ndarray]], order: int, uniform: float, rounds: int = 60) -> np.ndarray:
    """Weights [bucket, estimate] by expectation-maximisation; estimate 0 is uniform, n the maximum-likelihood one of
    order n. spread: for each bucket the cells' numbers of tokens and mean estimates [cell, order]. A bucket without
    tokens gets the weights of the next lower one."""
    out = np.zeros((BUCKETS + 1, order + 1))
    last = np.full(order + 1, 1 / (order + 1))
    for bucket in range(BUCKETS + 1):
        if bucket in spread:
            n, p = spread[bucket]
            p = np.column_stack([np.full(len(n), uniform), p])
            w = np.full(order + 1, 1 / (order + 1))
            for _ in range(rounds):
                share = w * p
                share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
                w = (n[:, None] * share).sum(0) + 0.5  # so that no weight is nothing
                w /= w.sum()
            last = w
        out[bucket] = last
    return out


def score(df: DataFrame, held_out: Column, order: int = 3, deleted_share: int = 8, block_bytes: int = 6 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every text with a model of those for which ``held_out`` (of the column doc_id) isn't true.

    Returns doc_id, held_out, n_tokens (words and the end), n_known (of them known to the training documents),
    train_tokens, base_score (log10, add-one unigrams) and score (log10, the model). A null or empty text has one
    token, its end. Repeated rows each count and each give a row; a null id is not held out. Without training
    documents nothing is known and both scores are 0 for each token. One block of ``deleted_share`` is deleted.
    """
    spark = df.sparkSession
    docs = two(df, id_col, text_col).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    size = docs.agg(F.sum(F.octet_length("text").cast("long")), F.count("*")).first()
    blocks = max(deleted_share, ceil((size[0] or 0) / block_bytes))
    parts = blocks
    rows = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "held_out", "text")
    dealt = rows.mapInArrow(_deal, DEALT)

    def ask(t: pa.Table) -> pa.Table:
        block, docs = t.column("block")[0].as_py(), _documents(t)
        token, begins, size = tokens(docs.column("text"))
        counted = np.repeat(np.where(docs.column("held_out").to_numpy(), 0, docs.column("times").to_numpy()), size)
        rows = []
        for kind, g in enumerate(grams(token, begins, order), 1):
            keys, where = np.unique(g, return_inverse=True)
            counts = np.bincount(where, counted, len(keys)).astype(np.int64)
            part = ((keys >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
            rows += [(kind, int(part[a]), block, low_bytes(keys[a:b], _key_bytes(kind)), pack_small(counts[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.Table.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int32(),) * 3 + (pa.binary(),) * 2, strict=True)], names=["kind", "part", "block", "keys", "counts"])

    def tell(t: pa.Table) -> pa.Table:
        kind = t.column("kind").to_pylist()
        raw = [keys_of(x, _key_bytes(kind[0])) for x in t.column("keys").to_pylist()]
        block = t.column("block").to_numpy()
        edges = np.cumsum([0, *map(len, raw)])
        counts = np.concatenate([unpack(zlib.decompress(x)) for x in t.column("counts").to_pylist()])
        keys, where = np.unique(np.concatenate(raw), return_inverse=True)
        gone = np.repeat(block % deleted_share == 0, np.diff(edges))
        main, every = (np.bincount(where, counts * part, len(keys)).astype(np.int64) for part in (~gone, 1))
        # only deleted blocks need the counts without them
        made = [[pack_small(x[where[a:b]]) if x is every or n % deleted_share == 0 else b"" for a, b, n in zip(edges[:-1], edges[1:], block, strict=True)] for x in (every, main)]
        tally = [int(x) for x in (main.sum(), np.count_nonzero(main), every.sum(), np.count_nonzero(every))]
        once = [pa.array([x if kind[0] == 1 else 0, *[0] * (len(raw) - 1)], pa.int64()) for x in tally]  # in one row of a range
        columns = [t.column("kind"), t.column("part"), t.column("block"), *(pa.array(x, pa.binary()) for x in made), *once]
        return pa.Table.from_arrays(columns, names=[x.split()[0] for x in TELL.split(", ")])

    told = settled(dealt.groupBy("block").applyInArrow(ask, ASK).groupBy("kind", "part").applyInArrow(tell, TELL))
    # the tokens and the distinct tokens, of the documents that aren't deleted and of all
    main_tokens, main_types, all_tokens, all_types = (x or 0 for x in told.agg(*(F.sum(c) for c in ("main_tokens", "main_types", "all_tokens", "all_types"))).first())
    trained = rows.where("not held_out")
    starts = trained.agg(F.count("*"), F.count_if(F.pmod("block", F.lit(deleted_share)) != 0)).first()

    def estimates(docs: pa.Table, answers: pa.Table, whole: bool):
        """Sizes of the texts, token counts, context buckets and estimates [token, order] from the answers."""
        token, begins, size = tokens(docs.column("text"))
        read = lambda x: unpack(zlib.decompress(x))
        order_of = np.lexsort((answers.column("part").to_numpy(), answers.column("kind").to_numpy()))
        kind = answers.column("kind").to_numpy()[order_of]
        counts = answers.column("whole" if whole else "main").to_pylist()
        n, documents = (all_tokens, starts[0]) if whole else (main_tokens, starts[1])
        p, context, first = np.zeros((len(token), order)), None, None
        for k, g in enumerate(grams(token, begins, order), 1):
            _, where = np.unique(g, return_inverse=True)
            mine = order_of[kind == k]
            count = np.concatenate([read(counts[i]) for i in mine])[where]
            if k == 1:
                first, below = count, np.full(len(token), n)
            else:
                below = np.empty_like(count)
                below[1:] = context[:-1]
                below[begins] = documents
            p[:, k - 1] = count / np.maximum(below, 1)
            context = count
        bucket = np.minimum(np.floor(np.log2(below + 1)), BUCKETS).astype(np.int64) if order > 1 else np.zeros(len(token), np.int64)
        return size, first, bucket, p

    cell_schema = "bucket int, " + "".join(f"q{k} int, " for k in range(1, order + 1)) + "n long, " + ", ".join(f"s{k} double" for k in range(1, order + 1))
    names = [x.split()[0] for x in cell_schema.split(", ")]

    answers = told.select("kind", "part", "block", "whole", "main")
    gone = F.pmod("block", F.lit(deleted_share)) == 0
    # a block's answers are for all its documents, so its held-out ones are needed too, to put n-grams in order
    found = dealt.where(gone).groupBy("block").cogroup(answers.where(gone).groupBy("block"))

    def cells(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = _documents(docs)
        size, _, bucket, p = estimates(docs, answers, False)
        times = np.repeat(np.where(docs.column("held_out").to_numpy(), 0, docs.column("times").to_numpy()), size)
        bucket, p, times = bucket[times > 0], p[times > 0], times[times > 0]
        with np.errstate(divide="ignore"):
            q = np.where(p > 0, np.floor(GRID * np.log2(np.maximum(p, 1e-300))), NEVER).astype(np.int64)
        code, span = bucket, 1 << 16
        for k in range(order):
            code = code * span + (q[:, k] - NEVER)
        key, at, where = np.unique(code, return_index=True, return_inverse=True)
        sums = [np.bincount(where, p[:, k] * times, len(key)).astype(float) for k in range(order)]
        columns = [pa.array(bucket[at], pa.int32()), *(pa.array(q[at, k], pa.int32()) for k in range(order)), pa.array(np.bincount(where, times, len(key)).astype(np.int64)), *map(pa.array, sums)]
        return pa.Table.from_arrays(columns, names=names)

    by_cell = found.applyInArrow(cells, cell_schema).groupBy(*names[: order + 1]).agg(*(F.sum(c).alias(c) for c in names[order + 1 :])).collect()  # a grid
    spread = {}
    for bucket in sorted({r["bucket"] for r in by_cell}):
        rows = [r for r in by_cell if r["bucket"] == bucket]
        n = np.array([r["n"] for r in rows], float)
        spread[bucket] = n, np.array([[r[f"s{k}"] for k in range(1, order + 1)] for r in rows]) / n[:, None]
    weights = learn(spread, order, 1 / (all_types + 1))

    out_schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def scores(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = _documents(docs)
        size, count, bucket, p = estimates(docs, answers, True)
        w = weights[bucket]
        mixed = w[:, 0] / (all_types + 1) + (w[:, 1:] * p).sum(1)
        begins = np.cumsum(size) - size
        add = lambda x: np.add.reduceat(x, begins)  # noqa: E731  every text has a token
        n = len(size)
        base = add(np.log10((count + 1) / (all_tokens + all_types + 1)))
        columns = [docs.column("doc_id"), docs.column("held_out"), pa.array(size), pa.array(add((count > 0).astype(np.int64))), pa.array(np.full(n, all_tokens)), pa.array(base), pa.array(add(np.log10(mixed)))]
        out = pa.Table.from_arrays(columns, names=[x.split()[0] for x in out_schema.split(", ")])
        times = docs.column("times").to_numpy()
        return out if (times == 1).all() else out.take(np.repeat(np.arange(n), times))

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scores, out_schema)

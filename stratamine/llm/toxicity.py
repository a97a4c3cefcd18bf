"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words that toxic texts of the labelled sample have far oftener than others. Features that depend on
it are made for each third of the sample with the lexicon of the other two, and the calibration is fitted to margins
of texts that the trees had not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratamine.llm.ship import settled, ship
from stratamine.llm.textvec import LOWER, pieces, span_hashes, word_spans
from stratamine.llm.tokens import two

#: The largest number of labelled rows that are learned from.
SAMPLE = 12_000
#: The largest number of words of the lexicon.
LEXICON = 1_000
FOLDS = 3
THRESHOLD = 0.3
NEAR = 5  # words between a second-person word and one of the lexicon

#: Second-person words of several languages.
YOU = "you your yours yourself u ur du dich dir dein deine deinen ihr euch sie tu te toi ton ta tes vous votre vos ti tus usted ustedes vosotros".split()
#: Letters that digits and signs stand for.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}

IS_LETTER = np.zeros(256, bool)
IS_LETTER[0x41:0x5B] = IS_LETTER[0x61:0x7B] = IS_LETTER[0x80:] = True
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
LEET = np.zeros(256, np.uint8)
for _a, _b in STANDS_FOR.items():
    LEET[ord(_a)] = ord(_b)
OPENED = LOWER.copy()
OPENED[LEET > 0] = LEET[LEET > 0]

NAMES = "words lexicon_density lexicon_weight lexicon_most lexicon_kinds strong_density near_you you_density capitals shouted exclaimed punctuation broken repeated hidden_density".split()


def hash_words(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends)


class Words:
    """The words of many texts: plain (letters only, lower-cased) and opened (with what stands for letters)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.starts, self.ends, self.row = word_spans(data, offsets)
        letter = IS_LETTER[data]
        self.plain, self.letters = self._hash(LOWER[data], letter)
        self.opened, self.all_letters = self._hash(OPENED[data], letter | (LEET[data] > 0))

    def _hash(self, x, keep):
        at = np.concatenate([[0], np.cumsum(keep)])
        a, b = at[self.starts], at[self.ends]
        return np.where(b > a, span_hashes(x[keep], a, b), 0), b - a

    def of(self, mask: np.ndarray) -> np.ndarray:
        """Bytes of each word under a mask."""
        at = np.concatenate([[0], np.cumsum(mask)])
        return at[self.ends] - at[self.starts]


def features(data: np.ndarray, offsets: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A row of NAMES for each text; lexicon: sorted hashes and their weights. Texts without words have zeros."""
    n = len(offsets) - 1
    w = Words(data, offsets)
    keys, weights = lexicon

    def look(h):
        if not len(keys):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, weights[at], 0.0)

    plain, opened = look(w.plain), look(w.opened)
    weight = np.maximum(plain, opened)
    hit, hidden = weight > 0, (opened > 0) & (plain == 0)
    you = np.isin(w.plain, YOU_HASHES)
    add = lambda x: np.bincount(w.row, x, n)
    count = add(np.ones(len(w.row)))
    per = np.maximum(count, 1)
    near, at = np.zeros(len(hit)), np.flatnonzero(hit)
    for d in range(-NEAR, NEAR + 1):
        j = at + d
        ok = (j >= 0) & (j < len(hit))
        ok[ok] = you[j[ok]] & (w.row[j[ok]] == w.row[at[ok]])
        near[at[ok]] = 1
    most = np.zeros(n)
    np.maximum.at(most, w.row, weight)
    kinds = np.zeros(n)
    if hit.any():
        pairs = np.unique(np.stack([w.row[hit].astype(np.uint64), w.opened[hit]]), axis=1)
        kinds = np.bincount(pairs[0].astype(np.int64), minlength=n).astype(float)
    length = np.maximum(np.diff(offsets), 1)
    bytes_of = lambda mask: np.add.reduceat(np.r_[mask, 0], np.r_[offsets[:-1]])[:n] * (np.diff(offsets) > 0)
    capitals, letters = w.of(UPPER[data]), w.letters
    inner = (w.ends - w.starts) - letters
    edge_before = ~IS_LETTER[data[w.starts]] if len(w.starts) else np.zeros(0, bool)
    edge_after = ~IS_LETTER[data[w.ends - 1]] if len(w.starts) else np.zeros(0, bool)
    broken = (inner > 0) & (letters > 0) & ~edge_before & ~edge_after
    triple = np.zeros(len(data), bool)
    triple[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & IS_LETTER[data[2:]]
    sign = ~IS_LETTER[data] & (data > 0x20) & ~((data >= 0x30) & (data < 0x3A))
    return np.column_stack(
        [
            np.log1p(count),
            add(hit) / per,
            np.log1p(add(weight)),
            most,
            np.log1p(kinds),
            add(weight > 2) / per,
            np.log1p(add(near)),
            add(you) / per,
            add(capitals) / length,
            add((capitals == letters) & (letters > 1)) / per,
            bytes_of((data == 0x21).astype(np.int64)) / per,
            bytes_of(sign.astype(np.int64)) / length,
            add(broken) / per,
            add(w.of(triple) > 0) / per,
            np.log1p(add(hidden)),
        ]
    )


YOU_HASHES = np.sort(hash_words(YOU))


class Trees:
    """Boosted trees of depth 3 with logistic loss, over features cut at quantiles."""

    DEPTH = 3

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 80, rate: float = 0.12, bins: int = 48, least: int = 15, ridge: float = 2.0):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        b = self._bin(x)
        mean = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.start = float(np.log(mean / (1 - mean)))
        self.trees = []
        f = np.full(len(y), self.start)
        inner = (1 << self.DEPTH) - 1
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            feature, cut = np.zeros(inner, np.int64), np.full(inner, 10**6)
            node = np.zeros(len(y), np.int64)
            for i in range(inner):
                rows = np.flatnonzero(node == i)
                best = (1e-6, 0, 10**6)
                if len(rows) >= 2 * least:
                    gr, hr = g[rows], h[rows]
                    whole = gr.sum() ** 2 / (hr.sum() + ridge)
                    for j in range(x.shape[1]):
                        size = len(self.cuts[j]) + 1
                        v = b[rows, j]
                        gl, hl = np.bincount(v, gr, size).cumsum()[:-1], np.bincount(v, hr, size).cumsum()[:-1]
                        nl = np.bincount(v, minlength=size).cumsum()[:-1]
                        gain = gl**2 / (hl + ridge) + (gr.sum() - gl) ** 2 / (hr.sum() - hl + ridge) - whole
                        gain[(nl < least) | (len(rows) - nl < least)] = 0
                        if len(gain) and gain.max() > best[0]:
                            best = (gain.max(), j, int(gain.argmax()))
                _, feature[i], cut[i] = best
                node[rows] = 2 * i + 1 + (b[rows, feature[i]] > cut[i])
            leaf = node - inner
            value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
            self.trees.append((feature, cut, value))
            f += value[leaf]

    def _bin(self, x):
        return np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)])

    def margins(self, x: np.ndarray) -> np.ndarray:
        b, f, rows = self._bin(x), np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.DEPTH):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            f += value[node - len(feature)]
        return f


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (x, fitted) of the nondecreasing fit by pooling adjacent violators; one for each pool's mean."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of y, count, sum of x
    for a, b in zip(x[order], y[order], strict=True):
        pools.append([b, 1.0, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


@dataclass
class Model:
    lexicon: tuple[np.ndarray, np.ndarray]
    trees: Trees | None
    curve: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities; a thousandth of the uncalibrated one keeps the order within a pool."""
        if self.trees is None:
            return np.full(len(x), float(self.curve[1][0]))
        m = self.trees.margins(x)
        return np.clip(0.999 * np.interp(m, *self.curve) + 0.001 / (1 + np.exp(-m)), 0, 1)


def _weights(rows: list, toxic: int, other: int) -> tuple[np.ndarray, np.ndarray]:
    """The lexicon from (word, texts with it that are toxic, that aren't)."""
    if not rows or not toxic or not other:
        return np.zeros(0, np.uint64), np.zeros(0)
    word = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    a, b = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    odds = np.log((a + 0.5) / (toxic - a + 0.5)) - np.log((b + 0.5) / (other - b + 0.5))
    spread = np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    good = (odds > 1) & (odds / spread > 3.5)
    word, odds, z = word[good], odds[good], (odds / spread)[good]
    best = np.argsort(-z, kind="stable")[:LEXICON]
    word, odds = word[best], odds[best]
    order = np.argsort(word)
    return word[order], odds[order]


def fit(df: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on at most ``sample`` labelled ids where ``learn`` (of the column doc_id) is true. An id counts once: with
    its largest label and its least text. Without rows of both labels the score is the share of toxic ones (0 without
    any)."""
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & learn)
    marks = marks.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    docs = two(df, id_col, text_col).join(F.broadcast(marks.toDF("l_id", "y")), F.col("doc_id") == F.col("l_id"))
    docs = docs.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))
    docs = settled(docs)  # the bounded sample

    def count(batches):
        for batch in batches:
            for low, high, data, offsets in pieces(batch.column(1)):
                w = Words(data, offsets)
                y, fold = batch.column(2).to_numpy()[low:high], batch.column(3).to_numpy()[low:high]
                some = w.all_letters > 1
                u = np.unique(np.stack([np.r_[w.row[some], w.row[some]].astype(np.uint64), np.r_[w.plain[some], w.opened[some]]]), axis=1)
                row = u[0].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(fold[row]), pa.array(u[1].view(np.int64)), pa.array((y[row] == 1).astype(np.int64)), pa.array((y[row] != 1).astype(np.int64))], names=["fold", "word", "a", "b"])

    found = docs.mapInArrow(count, "fold int, word long, a long, b long").groupBy("fold", "word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    wide = found.groupBy("word").agg(*(F.sum(F.when(F.col("fold") == i, F.col(c)).otherwise(0)).alias(f"{c}{i}") for i in range(FOLDS) for c in "ab"))
    total_a, total_b = (sum((F.col(f"{c}{i}") for i in range(1, FOLDS)), F.col(f"{c}0")) for c in "ab")
    # words of at least 4 toxic texts and at least as often in toxic ones: few of the sample's
    rows = wide.where((total_a >= 4) & (total_a * 4 >= total_b)).collect()
    sums = {(r["fold"], r["y"]): r["n"] for r in docs.groupBy("fold", (F.col("y") == 1).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    n = lambda y, folds: sum(sums.get((i, y), 0) for i in folds)
    every = range(FOLDS)
    take = lambda folds: _weights([(r["word"], sum(r[f"a{i}"] for i in folds), sum(r[f"b{i}"] for i in folds)) for r in rows], n(1, folds), n(0, folds))
    lexicon = take(every)
    if not n(1, every) or not n(0, every):
        return Model(lexicon, None, (np.zeros(1), np.array([1.0 if n(1, every) else 0.0])))
    parts = [take([j for j in every if j != i]) for i in every]

    def make(batches):
        for batch in batches:
            for low, high, data, offsets in pieces(batch.column(1)):
                fold = batch.column(3).to_numpy()[low:high]
                x = np.zeros((high - low, len(NAMES)))
                for i in every:
                    if (fold == i).any():
                        x[fold == i] = features(data, offsets, parts[i])[fold == i]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(2).slice(low, high - low), batch.column(3).slice(low, high - low), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "fold", "x"])

    made = sorted(docs.mapInArrow(make, "doc_id long, y int, fold int, x array<double>").collect(), key=lambda r: (r["doc_id"], r["y"], r["x"]))  # the bounded sample
    x, y, fold = np.array([r["x"] for r in made]), np.array([r["y"] == 1 for r in made], float), np.array([r["fold"] for r in made])
    margins = np.zeros(len(y))
    for i in every:
        if (fold == i).any() and (fold != i).any():
            margins[fold == i] = Trees(x[fold != i], y[fold != i]).margins(x[fold == i])
    return Model(lexicon, Trees(x, y), isotonic(margins, y))


def with_toxicity(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of df, then score (0 to 1) and predicted (1 from THRESHOLD on) of every whole text. A null or empty text
    is scored by its features, all 0. Columns of df with those names are replaced."""
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)
    df = df.drop("score", "predicted")
    where, names = df.columns.index(text_col), [*df.columns, "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            parts = [m.score(features(data, offsets, m.lexicon)) for _, _, data, offsets in pieces(batch.column(where))]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *T._parse_datatype_string("score double, predicted int").fields]))


def assess(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted. Repeated rows each give a row; a null id stays null."""
    return with_toxicity(two(df, id_col, text_col), model).drop("text")

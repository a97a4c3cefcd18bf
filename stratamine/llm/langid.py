"""Language identification by error-correcting output codes.

Every language has a codeword; for each of its bits a logistic classifier over hashed byte n-grams predicts the bit.
A text goes to the language whose codeword its bits contradict least, each bit's logistic loss weighed by how well
its classifier does on that language. If the two best are close the text is marked ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratamine.llm.ship import ship
from stratamine.llm.textvec import U64, pieces
from stratamine.llm.tokens import two

BITS = 13
ORDERS = (2, 3, 4)
DIM = len(ORDERS) << BITS
PIECE = 1 << 18
#: The largest number of texts of each language that the classifiers are fitted on.
SAMPLE = 400
#: Below this difference of the two best shares a text is ambiguous.
CLOSE = 0.2

#: Letters of A-Z lower-cased, bytes of other characters kept, everything else a gap.
FOLD = np.full(256, 0x20, np.uint8)
FOLD[0x80:] = np.arange(0x80, 0x100)
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the feature of each n-gram, and the row of each. Runs of gaps count as one; n-grams don't cross
    texts."""
    x = FOLD[data]
    gap = x == 0x20
    first = np.zeros(len(x) + 1, bool)
    first[offsets] = True
    keep = ~gap
    keep[1:] |= gap[1:] & (~gap[:-1] | first[1:-1])
    keep[:1] = True
    x = x[keep]
    edges = np.concatenate([[0], np.cumsum(keep)])[offsets]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(edges))
    for i, n in enumerate(ORDERS):
        if len(x) < n:
            continue
        h = np.zeros(len(x) - n + 1, np.uint64)
        for j in range(n):
            h = h << U64(8) | x[j : len(x) - n + 1 + j]
        inside = row[: len(x) - n + 1] == row[n - 1 :]
        h = (h * U64(0x9E3779B97F4A7C15)) >> U64(64 - BITS)
        yield h[inside].astype(np.int64) + (i << BITS), row[: len(x) - n + 1][inside]


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    x = FOLD[data]
    total = np.concatenate([[0], np.cumsum((x != 0x20) & (x < 0x80))])
    some = total[offsets[1:]] > total[offsets[:-1]]
    total = np.concatenate([[0], np.cumsum(data >= 0x80)])
    for i in np.flatnonzero(~some & (total[offsets[1:]] > total[offsets[:-1]])).tolist():
        some[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8"))
    return some


def codewords(languages: int) -> np.ndarray:
    """One row of +1 and -1 for each language: all ways to divide up to 5 of them, else the best of some random
    codes by the least distance of two rows."""
    if languages < 2:
        return np.ones((languages, 1), np.int8)
    if languages <= 5:
        masks = range(1, 1 << (languages - 1))
        return np.array([[1 if i == 0 or not m >> (i - 1) & 1 else -1 for m in masks] for i in range(languages)], np.int8)
    length = int(np.ceil(10 * np.log2(languages)))
    rng, best = np.random.default_rng(5), (-1, None)
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (languages, length))
        apart = ((length - code.astype(int) @ code.T) // 2 + length * np.eye(languages, dtype=int)).min()
        best = max(best, (apart, code), key=lambda x: x[0])
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # [feature, bit]
    bias: np.ndarray
    trust: np.ndarray  # [language, bit]: share of the language's texts whose bit is predicted, each row's mean 1

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        total, count = np.zeros((n, self.weights.shape[1])), np.zeros(n)
        for f, row in features(data, offsets):
            if not len(f):
                continue
            begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            total[row[begin]] += np.add.reduceat(self.weights[f], begin, axis=0)
            count += np.bincount(row, minlength=n)
        return total / np.maximum(count, 1)[:, None] + self.bias

    def shares(self, margins: np.ndarray) -> np.ndarray:
        """For each text the shares of the languages, from the weighed losses of their codewords."""
        agree = margins[:, None, :] * self.code
        loss = (self.trust * np.logaddexp(0, -agree)).sum(2)
        e = np.exp(-(loss - loss.min(1, keepdims=True)))
        return e / e.sum(1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = 120) -> Model:
    """x: shares of features [text, feature], which are scaled in place; y: numbers of languages. Logistic regression for
    each bit, by Adam."""
    code = codewords(len(languages))
    if not len(x):
        return Model(languages, code, np.zeros((DIM, code.shape[1]), np.float32), np.zeros(code.shape[1]), np.ones(code.shape))
    scale = (1 / np.sqrt(x.mean(0) + 1e-5)).astype(np.float32)
    x *= scale
    norm = np.sqrt(np.einsum("ij,ij->i", x, x)).mean()
    x /= norm
    scale /= norm
    z, target = x, code[y].astype(np.float32)
    each = 1 / np.maximum(np.bincount(y, minlength=len(languages)), 1)[y]
    each = (each / each.sum()).astype(np.float32)[:, None]
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m = [np.zeros_like(w), np.zeros_like(b)]
    v = [np.zeros_like(w), np.zeros_like(b)]
    for t in range(1, steps + 1):
        f = z @ w + b
        g = -target * each / (1 + np.exp(np.clip(target * f, -30, 30)))
        for k, (p, d) in enumerate(((w, z.T @ g + 1e-5 * w), (b, g.sum(0)))):
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.99 * v[k] + 0.01 * d * d
            p -= 0.15 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)
    right = (z @ w + b) * target > 0
    trust = np.array([right[y == i].mean(0) if (y == i).any() else np.ones(code.shape[1]) for i in range(len(languages))]) + 1e-3
    return Model(languages, code, w * scale[:, None], b.astype(float), trust / trust.mean(1, keepdims=True))


def fit(df: DataFrame, learn: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits on at most ``sample`` texts of each language among rows where ``learn`` (of the column doc_id) is true and
    the language isn't null. Texts are read whole; the driver gets their n-gram counts. An id counts once for each of its
    languages, by its least text, and rows without an id as one; so repeated rows don't enlarge the sample. Only some twice
    as many ids as the sample are put in order."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(learn, F.lit(True)))
    ids, drawn = docs.select("doc_id", "lang").distinct(), F.xxhash64("doc_id", "lang")
    counts = ids.groupBy("lang").agg(F.count("*").alias("n"))  # a row for each language
    few = ids.join(F.broadcast(counts), "lang").where(F.pmod(drawn, F.lit(1 << 31)) * F.col("n") < 2.0 * sample * (1 << 31))
    order = Window.partitionBy("lang").orderBy(drawn, "doc_id")
    chosen = few.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample).select(F.col("doc_id").alias("c_id"), F.col("lang").alias("c_lang"))
    some = docs.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("lang") == F.col("c_lang")), "left_semi")
    some = some.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("doc_id", "text", "lang")
    two(df, id_col, text_col)

    def run(batches):
        for batch in batches:
            for low, high, data, offsets in pieces(batch.column(1), PIECE):
                found = list(features(data, offsets))
                f = np.concatenate([x[0] for x in found]) if found else np.zeros(0, np.int64)
                row = np.concatenate([x[1] for x in found]) if found else np.zeros(0, np.int64)
                key, n = np.unique(row * DIM + f, return_counts=True)
                cut = np.searchsorted(key // DIM, np.arange(high - low + 1))
                raw = [((key[a:b] % DIM).astype("<u2").tobytes(), n[a:b].astype("<u4").tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(low, high - low), pa.array([a for a, _ in raw], pa.binary()), pa.array([b for _, b in raw], pa.binary())], names=["lang", "at", "n"])

    rows = sorted((r["lang"], bytes(r["at"]), bytes(r["n"])) for r in some.mapInArrow(run, "lang string, at binary, n binary").collect())  # the bounded sample
    languages = sorted({r[0] for r in rows})
    x, y = np.zeros((len(rows), DIM), np.float32), np.array([languages.index(r[0]) for r in rows], np.int64)
    for i, (_, at, n) in enumerate(rows):
        c = np.frombuffer(n, "<u4").astype(np.float32)
        x[i, np.frombuffer(at, "<u2")] = c / max(c.sum(), 1)
    return train(x, y, languages)


def _predict(m: Model, column: pa.Array):
    """lang_pred, score, ambiguous and second for a string column."""
    names = np.array([*m.languages, "und"], object)
    out: list[list] = [[], [], [], []]
    for low, high, data, offsets in pieces(column, PIECE):
        n = high - low
        if m.languages:
            known = has_letter(data, offsets)
            share = m.shares(m.margins(data, offsets))
            order = np.argsort(-share, axis=1, kind="stable")
            best, score = order[:, 0], share[np.arange(n), order[:, 0]]
            next_ = order[:, 1] if len(m.languages) > 1 else None
            gap = score - (share[np.arange(n), next_] if next_ is not None else 0)
        else:
            known, best, score, next_, gap = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n), None, np.zeros(n)
        best = np.where(known, best, len(m.languages))
        out[0] += names[best].tolist()
        out[1] += np.where(known, score, 0.0).tolist()
        out[2] += ((gap < CLOSE) | ~known).tolist()
        out[3] += [None] * n if next_ is None else [names[j] if k else None for j, k in zip(next_, known, strict=True)]
    return [pa.array(x, kind) for x, kind in zip(out, (pa.string(), pa.float64(), pa.bool_(), pa.string()), strict=True)]


PREDICTED = "lang_pred string, score double, ambiguous boolean, second string"


def with_language(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of df, then lang_pred, score (the language's share, 0 to 1), ambiguous and second (the next
    language) of every whole text. A text that is null, empty or has no letter is ``und`` with score 0, ambiguous, without
    a second, and so is every text under a model without languages. Columns of df with those names are replaced."""
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)
    added = [x.split()[0] for x in PREDICTED.split(", ")]
    df = df.drop(*added)
    where, names = df.columns.index(text_col), [*df.columns, *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *_predict(sent.value, batch.column(where))], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *T._parse_datatype_string(PREDICTED).fields]))


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and what ``with_language`` adds. Repeated rows each give a row; a null id stays null."""
    return with_language(two(df, id_col, text_col), model).drop("text")

"""Byte-level BPE encoding with decoding, and token counts.

Both read whole texts through Arrow buffers and shuffle nothing. A null text counts as an empty one, an empty text
has no tokens, repeated rows each give a row, a null id stays null, and columns other than the two named are not
looked at, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamine.llm import bpe
from stratamine.llm.ship import ship
from stratamine.llm.textvec import buffers, pieces


def two(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id as ``doc_id`` (long) and the text (null: empty), and nothing else."""
    ship(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column of data[bounds[i]:bounds[i + 1]]; bounds in bytes."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Token ids of every text by the ranks in ``path``, without special tokens.

    Each match of the usual pattern is looked up whole in a minimal perfect hash of the vocabulary; what isn't there
    is merged by a heap over linked bytes and kept in the worker's bounded cache.

    Returns doc_id, n_tokens (long), ids (binary: little-endian unsigned 32-bit) and, if asked for, decoded (binary:
    the bytes that the ids stand for).
    """
    vocabulary = df.sparkSession.sparkContext.broadcast(bpe.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = bpe.worker_encoder(vocabulary, False, True)
        for batch in batches:
            ids_col, texts = batch.column(0), batch.column(1)
            for low, high, data, offsets in pieces(texts):
                ids, bounds = e.encode(data, offsets)
                out = [ids_col.slice(low, high - low), pa.array(np.diff(bounds)), _binary(ids.astype("<u4").view(np.uint8), bounds * 4)]
                if decoded:
                    sizes = np.concatenate([[0], np.cumsum(e.v.lengths[ids])])
                    out.append(_binary(e.decode(ids), sizes[bounds]))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids", "decoded"][: len(out)])

    return two(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decoded)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the decoded bytes (binary) of ids as ``encode`` returns them; null ids decode to no bytes."""
    vocabulary = df.sparkSession.sparkContext.broadcast(bpe.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = bpe.worker_encoder(vocabulary, False, True)
        for batch in batches:
            made = [e.decode(np.frombuffer(x or b"", "<u4").astype(np.int64)).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["doc_id", "decoded"])

    ship(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, decoded binary")


#: The table of frequent pre-tokens has at most so many, counted over some so many rows.
TABLE, SAMPLE = 65_536, 4_000


def _frequent(docs: DataFrame, vocabulary) -> bpe.Lengths:
    """The lengths of the pre-tokens that occur most often in a sample of the texts and more than once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = bpe.worker_encoder(vocabulary, True, False)
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(1)):
                keys, n, size = e.spans(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.view(np.int64), size, n)], names=["key", "size", "n"])

    share = min(1.0, SAMPLE / max(1, docs.select("doc_id").count()))
    counted = docs.sample(share, 1).mapInArrow(count, "key long, size long, n long").groupBy("key", "size").agg(F.sum("n").alias("n"))
    rows = counted.where("n > 1 and size < 65536").orderBy(F.desc("n"), "key").limit(TABLE).collect()  # a bounded table
    return bpe.Lengths(np.array([r["key"] for r in rows], np.int64).view(np.uint64), np.array([r["size"] for r in rows], np.int64))


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every text: doc_id, n_bytes, n_tokens (long).

    For a byte-level JSON file the count is map-side and in two tiers. The driver broadcasts a compact hash table of
    the lengths of frequent pre-tokens, at most ``TABLE``, counted over some ``SAMPLE`` rows; what isn't there, each worker
    encodes once and keeps in its bounded cache. The table only saves time: lengths are the same from either tier.
    Strings of special tokens inside a text count one, as the library's default has it. A ``.model`` file, or a JSON
    file of another kind, goes through its own library, text by text.
    """
    sc = df.sparkSession.sparkContext
    try:
        plain = path.endswith(".json") and bpe.load(path)
    except (ValueError, KeyError):
        plain = None
    docs, schema = two(df, id_col, text_col), "doc_id long, n_bytes long, n_tokens long"
    if plain:
        vocabulary = sc.broadcast(plain)
        lengths = sc.broadcast(_frequent(docs, vocabulary))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            e = bpe.worker_encoder(vocabulary, True, False)
            for batch in batches:
                got = [(np.diff(offsets), e.counts(data, offsets, lengths.value)) for _, _, data, offsets in pieces(batch.column(1))]
                sizes, counts = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 2
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(counts)], names=["doc_id", "n_bytes", "n_tokens"])

        return docs.mapInArrow(run, schema)
    with open(path, "rb") as f:
        content = sc.broadcast((path.endswith(".model"), f.read()))

    def library(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, raw = content.value
        if model:
            import sentencepiece

            s = sentencepiece.SentencePieceProcessor(model_proto=raw)
            count = lambda texts: [len(s.encode(t)) for t in texts]
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_str(raw.decode("utf-8"))
            t.no_truncation()
            t.no_padding()
            count = lambda texts: [len(t.encode(x, add_special_tokens=False)) for x in texts]
        for batch in batches:
            _, offsets = buffers(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(count(batch.column(1).to_pylist()), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.mapInArrow(library, schema)


def encode_ids(e: bpe.Encoder, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Little-endian unsigned 32-bit ids of many texts, each followed by ``end_id``, and their bounds."""
    ids, bounds = e.encode(data, offsets)
    n = len(offsets) - 1
    edges = bounds + np.arange(n + 1)
    out = np.empty(len(ids) + n, "<u4")
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(bounds))] = ids
    out[edges[1:] - 1] = end_id
    return out, edges

"""Whole texts as numpy arrays: Arrow string columns are read through their own buffers, so that no Python
string is made for a document, and words and hashes are found for many documents at once.

A batch is worked on in pieces of about ``CHUNK`` bytes (a document is never divided), which bounds a worker's
memory by the piece or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
U64 = np.uint64

#: Words end at space, tab, line feed, vertical tab, form feed and carriage return.
IS_GAP = np.zeros(256, bool)
IS_GAP[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = U64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An ordered hash of two hashes."""
    return mix(a * U64(0xD6E8FEB86659FD93) + mix(b) + U64(0x632BE59BD9B4E019))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        n = max(n, CHUNK + 4096)
        inverse = U64(pow(int(_BASE), -1, 2**64))
        _POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BASE), dtype=np.uint64)])
        _INVERSE = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, inverse), dtype=np.uint64)])
    return _POWERS, _INVERSE


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans data[start:end], from one running sum over all bytes."""
    powers, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers[: len(data)], out=total[1:])
    value = (total[ends] - total[starts]) * inverse[starts]
    return mix(value + (ends - starts).astype(np.uint64) * U64(0xA24BAED4963EE407))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    _, where, data = column.buffers()
    if not n or where is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def pieces(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of texts of about ``size`` bytes."""
    data, offsets = buffers(column)
    n, low = len(offsets) - 1, 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the row of each; a word never crosses two texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~IS_GAP[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | first[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | first[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z lower-cased, in order, and the row of each."""
    low = LOWER[data]
    starts, ends, row = word_spans(low, offsets)
    return span_hashes(low, starts, ends), row


def counts_by_row(row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, minlength=n).astype(np.int64)


def bounds(row: np.ndarray, n: int) -> np.ndarray:
    """n + 1 bounds of the rows' runs in a sorted row column."""
    return np.searchsorted(row, np.arange(n + 1))


def run_sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values[edges[i]:edges[i + 1]]; 0 for an empty run."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind in "iuf" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]


def concat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + lengths[0] - 1, then the next range, and so on."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def low_bytes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of sorted whole numbers, all lowest bytes first and so on: the high ones compress."""
    return x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def keys_of(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()

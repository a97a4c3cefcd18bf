"""Byte-level BPE by two tiers: a minimal perfect hash for whole pre-tokens in the vocabulary, and a heap over
linked bytes for the rest, with a bounded cache in each worker.

``Vocabulary`` holds the ranks (a file of base64 tokens and ranks, or the ``vocab`` and ``merges`` of a JSON
file). It is built once on the driver and broadcast; it has as many entries as the vocabulary, whatever the data.
``Encoder`` is a worker's own: it splits many texts into pre-tokens at once, looks all distinct ones up, and
merges only those that neither the vocabulary nor its cache knows.
"""

from __future__ import annotations

import base64
import heapq
import json
from functools import lru_cache

import numpy as np

from stratamine.llm.textvec import U64, concat_ranges, mix, span_hashes

GAP, LETTER, NUMBER, OTHER = range(4)


@lru_cache(1)
def kinds() -> np.ndarray:
    """GAP, LETTER, NUMBER or OTHER of each code point."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((GAP, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        found = "".join(regex.findall(pattern + "+", every))
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return table


def pretoken_spans(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the pre-tokens of texts that begin at ``breaks`` (sorted; the last is the end).

    The pattern: contractions ('s 't 're 've 'm 'll 'd), runs of letters, of numbers or of other characters, each
    with one space before it if there is one, and runs of white space, of which the last character stands alone
    where something follows.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if data.max() < 128:
        points, at = data, None
        kind = kinds()[:128][data]
    else:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        at = np.concatenate([[0], np.cumsum(width)])
        breaks = np.searchsorted(at, breaks)
        kind = kinds()[points]
    n = len(points)
    first = np.zeros(n + 1, bool)
    first[breaks] = True
    first[n] = True
    change = first[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    gap = kind == GAP
    start = change.copy()
    # a space before a run belongs to it
    joined = np.zeros(n, bool)
    joined[1:] = ~gap[1:] & (points[:-1] == 0x20) & ~first[1:n]
    start &= ~joined
    # the last of a run of white space, where something follows
    last = gap.copy()
    last[-1] = False
    last[:-1] &= ~gap[1:] & ~first[1:n]
    start |= last
    quote = np.flatnonzero(start & (points == 0x27))
    quote = quote[quote + 1 < n]
    if len(quote):
        quote = quote[~first[quote + 1]]
        one = points[quote + 1]
        single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        room = quote + 2 < n
        two = np.where(room, points[np.minimum(quote + 2, n - 1)], 0)
        room &= ~first[np.minimum(quote + 2, n)]
        double = room & (((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C)))
        for which, length in ((single, 2), (double, 3)):
            start[quote[which] + 1] = False
            after = quote[which] + length
            after = after[after < n]
            start[after] = True
            # white space and joined characters keep their own rules; a letter after a contraction starts anew
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    return (starts, ends) if at is None else (at[starts], at[ends])


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys by levels of bits: a key takes the first level where it has
    a bit alone; its number is the rank of that bit. A stored key tells members from others."""

    def __init__(self, keys: np.ndarray, room: float = 2.0):
        self.levels: list[tuple[int, int, int]] = []  # seed, start, bits
        marks, rest, start = [], keys, 0
        while len(rest):
            bits = max(64, int(len(rest) * room))
            slot = self._slot(rest, len(self.levels), bits)
            alone = np.bincount(slot, minlength=bits) == 1
            marks.append(alone)
            self.levels.append((len(self.levels), start, bits))
            start += bits
            rest = rest[~alone[slot]]
        self.marks = np.concatenate(marks) if marks else np.zeros(0, bool)
        self.ranks = (np.cumsum(self.marks) - 1).astype(np.int32)
        self.keys = np.zeros(len(keys), np.uint64)
        self.keys[self._find(keys)] = keys

    @staticmethod
    def _slot(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (mix(keys + U64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % U64(bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, start, bits in self.levels:
            slot = start + self._slot(keys[left], level, bits)
            hit = self.marks[slot]
            out[left[hit]] = self.ranks[slot[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for what isn't a member."""
        out = self._find(keys)
        known = out >= 0
        known[known] = self.keys[out[known]] == keys[known]
        return np.where(known, out, -1)


def _bytes_of_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in JSON vocabularies: printable bytes stand for themselves,
    the others follow from 256 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens by id, the pairs that merge, and the perfect hash of the tokens that are whole pre-tokens."""

    def __init__(self, tokens: dict[bytes, int], pairs: dict[tuple[int, int], tuple[int, int]], special: dict[bytes, int]):
        self.tokens, self.special = tokens, special
        size = max([*tokens.values(), *special.values()]) + 1
        by_id = [b""] * size
        for token, i in tokens.items():
            by_id[i] = token
        for token, i in special.items():
            by_id[i] = token
        self.lengths = np.array([len(t) for t in by_id], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.blob = np.frombuffer(b"".join(by_id), np.uint8)
        self.byte_ids = np.array([tokens[bytes([b])] for b in range(256)], np.int64)
        self.first = self.byte_ids.tolist()
        #: pair of ids, as left * 2**20 + right, to the order of its merge; the id that a merge makes
        self.orders = {(a << 20) | b: order for (a, b), (order, _) in pairs.items()}
        self.made = dict(pairs.values())
        self.table = PairTable(pairs)
        names = [t for t in tokens if t]
        blob = np.frombuffer(b"".join(names), np.uint8)
        ends = np.cumsum([len(t) for t in names])
        starts = ends - [len(t) for t in names]
        keys = span_hashes(blob, starts, ends)
        ids = np.array([tokens[t] for t in names], np.int64)
        #: a token is its own encoding only if the merges lead to it
        whole = np.array([self.merge(t) == [tokens[t]] for t in names])
        self.hash = PerfectHash(keys[whole])
        self.whole_ids = np.zeros(int(whole.sum()), np.int32)
        self.whole_ids[self.hash._find(keys[whole])] = ids[whole]

    @classmethod
    def from_ranks(cls, path: str) -> Vocabulary:
        """A file of base64 tokens and ranks; two tokens merge if their bytes together are a token, lowest rank first."""
        with open(path, "rb") as f:
            tokens = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pairs = {}
        for token, rank in tokens.items():
            for cut in range(1, len(token)):
                a, b = tokens.get(token[:cut]), tokens.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = (rank, rank)
        return cls(tokens, pairs, {})

    @classmethod
    def from_json(cls, path: str) -> Vocabulary:
        """A JSON file of the tokenizers library, of the byte-level BPE kind with its usual pattern."""
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, pre = whole["model"], whole.get("pre_tokenizer") or {}
        plain = model.get("type", "BPE") == "BPE" and not model.get("ignore_merges") and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        if not plain or whole.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        code = _bytes_of_symbols()
        special = {x["content"].encode(): x["id"] for x in whole["added_tokens"]}
        if any(x[k] for x in whole["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} has added tokens that take in what surrounds them")
        ids = model["vocab"]
        tokens = {bytes(code[c] for c in t): i for t, i in ids.items() if i not in special.values() and all(c in code for c in t)}
        pairs = {}
        for order, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pairs[ids[a], ids[b]] = (order, ids[a + b])
        return cls(tokens, pairs, special)

    def merge(self, token: bytes) -> list[int]:
        """Ids of one pre-token: the bytes are linked both ways, and a heap gives the pair with the lowest order,
        leftmost first, until none is left. An entry is stale if either side has changed since."""
        first = self.first
        ids = [first[b] for b in token]
        n, get, made = len(ids), self.orders.get, self.made
        heap = []
        for i in range(n - 1):
            order = get(ids[i] << 20 | ids[i + 1])
            if order is not None:
                heap.append(order << 32 | i)
        if not heap:
            return ids
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            i, order = top & 0xFFFFFFFF, top >> 32
            left, j = ids[i], after[i]
            if left < 0 or j >= n or get(left << 20 | ids[j]) != order:
                continue
            ids[i], ids[j] = new, _ = made[order], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                order = get(new << 20 | ids[k])
                if order is not None:
                    push(heap, order << 32 | i)
            h = before[i]
            if h >= 0:
                order = get(ids[h] << 20 | new)
                if order is not None:
                    push(heap, order << 32 | h)
        return [x for x in ids if x >= 0]

    def merge_many(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their counts of many pre-tokens at once, by the same order of merges: in each round every
        pre-token makes its first merge. For those of up to 32 bytes; longer ones take the heap."""
        size = ends - starts
        counts = np.ones(len(size), np.int64)
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        for low, high in ((1, 8), (9, 12), (13, 18), (19, 32)):
            rows = np.flatnonzero((size >= low) & (size <= high))
            for part in np.array_split(rows, -(-len(rows) // 50_000)) if len(rows) else []:
                ids, n = self._rounds(data, starts[part], size[part], high)
                counts[part] = n
                kept.append((np.repeat(part, n), ids))
        for row in np.flatnonzero(size > 32).tolist():
            ids = self.merge(data[starts[row] : ends[row]].tobytes())
            counts[row] = len(ids)
            kept.append((np.full(len(ids), row), np.array(ids)))
        if not kept:
            return np.zeros(0, np.int32), counts
        row = np.concatenate([x[0] for x in kept])
        return np.concatenate([x[1] for x in kept])[np.argsort(row, kind="stable")].astype(np.int32), counts

    def _rounds(self, data, starts, size, width):
        far = np.iinfo(np.int64).max
        place = np.arange(width)
        ids = np.where(place < size[:, None], self.byte_ids[data[np.minimum(starts[:, None] + place, len(data) - 1)]], -1)
        n = size.copy()
        orders, made = self.table.find(ids[:, :-1], ids[:, 1:])
        work = np.arange(len(ids))
        while len(work) and orders.shape[1]:
            best = orders[work].argmin(1)
            found = orders[work, best] < far
            work, best = work[found], best[found]
            if not len(work):
                break
            new = made[work, best]
            shift = place[None, :-1] + (place[None, :-1] > best[:, None])
            moved = np.take_along_axis(ids[work], shift, 1)
            moved[np.arange(len(work)), best] = new
            ids[work, :-1], ids[work, -1] = moved, -1
            for table in (orders, made):
                table[work, :-1] = np.take_along_axis(table[work], shift[:, :-1], 1)
            orders[work, -1] = far
            n[work] -= 1
            at = np.concatenate([best, best - 1])
            who = np.concatenate([work, work])
            who, at = who[at >= 0], at[at >= 0]
            fine = at < orders.shape[1]
            who, at = who[fine], at[fine]
            orders[who, at], made[who, at] = self.table.find(ids[who, at], ids[who, at + 1])
        return ids[ids >= 0], n


class PairTable:
    """Order and made id of pairs of ids, for arrays; open addressing."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.bits = max(8, int(len(pairs) * 2.5).bit_length())
        keys = np.array([(a << 32) | b for a, b in pairs], np.int64)
        self.keys, self.entry = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        values = np.array(list(pairs.values()), np.int64).reshape(-1, 2)
        self.order, self.made = np.append(values[:, 0], np.iinfo(np.int64).max), np.append(values[:, 1], -1)
        left, slot, mask = np.arange(len(keys)), self._slot(keys), (1 << self.bits) - 1
        while len(left):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[left[free]]
            won = free & (self.keys[slot] == keys[left])
            self.entry[slot[won]] = left[won]
            left, slot = left[~won], (slot[~won] + 1) & mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, made); the largest integer and -1 where the pair doesn't merge or an id is negative."""
        keys = ((left.astype(np.int64) << 32) | right).ravel()
        out = np.full(len(keys), len(self.order) - 1, np.int64)
        rest = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        slot, mask = self._slot(keys[rest]), (1 << self.bits) - 1
        while len(rest):
            there = self.keys[slot]
            hit = there == keys[rest]
            out[rest[hit]] = self.entry[slot[hit]]
            go = ~hit & (there != -1)
            rest, slot = rest[go], (slot[go] + 1) & mask
        return self.order[out].reshape(left.shape), self.made[out].reshape(left.shape)


class Cache:
    """An open-addressing table from the hash of a pre-token to its ids; emptied when half full, so it is bounded."""

    def __init__(self, bits: int = 21):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.entry = np.zeros(1 << self.bits, np.int32)
        self.starts, self.sizes, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), 0
        self.flat, self.used = np.zeros(1 << 14, np.int32), 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left, slot, mask = np.arange(len(keys)), self._slot(keys), (1 << self.bits) - 1
        while len(left):
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.entry[slot[hit]]
            go = ~hit & (there != 0)
            left, slot = left[go], (slot[go] + 1) & mask
        return out

    def room(self, more: int) -> None:
        """Before a look-up that may add ``more`` keys."""
        if self.count + more > 1 << (self.bits - 1):
            self.clear()

    def add(self, keys: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Keys are distinct and new; returns their entries."""
        while len(self.starts) < self.count + len(keys):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        while len(self.flat) < self.used + len(flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        entries = np.arange(self.count, self.count + len(keys))
        self.starts[entries] = self.used + np.cumsum(sizes) - sizes
        self.sizes[entries] = sizes
        self.flat[self.used : self.used + len(flat)] = flat
        self.count += len(keys)
        self.used += len(flat)
        if self.count <= 1 << (self.bits - 1):  # else a single piece has too many; room() clears before the next
            left, slot, mask = np.arange(len(keys)), self._slot(keys), (1 << self.bits) - 1
            while len(left):
                free = self.keys[slot] == 0
                self.keys[slot[free]] = keys[left[free]]
                won = free & (self.keys[slot] == keys[left])
                self.entry[slot[won]] = entries[left[won]]
                left, slot = left[~won], (slot[~won] + 1) & mask
        return entries


class Lengths:
    """A compact table from the hashes of pre-tokens to their lengths in tokens: open addressing, half full at most."""

    def __init__(self, keys: np.ndarray, sizes: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.sizes = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint16)
        left, slot, mask = np.arange(len(keys)), self._slot(keys), (1 << self.bits) - 1
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[left[free]]
            won = self.keys[slot] == keys[left]
            self.sizes[slot[won]] = sizes[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The lengths, 0 for what isn't there."""
        out = np.zeros(len(keys), np.int64)
        left, slot, mask = np.arange(len(keys)), self._slot(keys), (1 << self.bits) - 1
        while len(left):
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.sizes[slot[hit]]
            go = ~hit & (there != 0)
            left, slot = left[go], (slot[go] + 1) & mask
        return out


class Encoder:
    """Encodes many texts at once. ``specials``: whether the strings of special tokens in a text are those tokens.
    ``heap``: whether every miss goes through the heap; else the short ones go through rounds of merges together."""

    def __init__(self, vocabulary: Vocabulary, specials: bool = False, heap: bool = True, bits: int = 21):
        self.v, self.cache, self.heap = vocabulary, Cache(bits), heap
        self.specials = vocabulary.special if specials else {}

    def pretokens(self, data: np.ndarray, offsets: np.ndarray, frequent: Lengths | None = None):
        """Sizes of the pre-tokens in tokens, the place of their ids in self.flat (none for those in ``frequent``), and
        their byte starts."""
        special, whole = [], data.tobytes() if self.specials else b""
        for name, i in self.specials.items():
            at = -1
            while (at := whole.find(name, at + 1)) >= 0:
                if np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + len(name) - 1, "right"):
                    special.append((at, at + len(name), i))
                    at += len(name) - 1
        breaks = offsets if not special else np.unique(np.concatenate([offsets, [x for s in special for x in s[:2]]]))
        starts, ends = pretoken_spans(data, breaks)
        keys, first, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if frequent:
            sizes, places = frequent.find(keys), np.zeros(len(keys), np.int64)
            miss = np.flatnonzero(sizes == 0)
            sizes[miss], places[miss] = self._resolve(data, starts[first[miss]], ends[first[miss]], keys[miss])
        else:
            sizes, places = self._resolve(data, starts[first], ends[first], keys)
        sizes, places = sizes[inverse], places[inverse]
        for low, high, i in special:
            k = np.searchsorted(starts, [low, high])
            sizes[k[0] : k[1]] = 0
            sizes[k[0]], places[k[0]] = 1, len(self.flat)
            self.flat = np.append(self.flat, i)
        return sizes, places, starts

    def _resolve(self, data, starts, ends, keys):
        number = self.v.hash.find(keys)
        known = number >= 0
        miss = np.flatnonzero(~known)
        self.cache.room(len(miss))
        entry = self.cache.find(keys[miss])
        new = miss[entry < 0]
        if len(new):
            if self.heap:
                raw, merge = data.tobytes(), self.v.merge
                made = [merge(raw[a:b]) for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
                counts = np.fromiter(map(len, made), np.int64, len(made))
                flat = np.fromiter((x for ids in made for x in ids), np.int32, int(counts.sum()))
            else:
                flat, counts = self.v.merge_many(data, starts[new], ends[new])
            entry[entry < 0] = self.cache.add(keys[new], counts, flat)
        sizes, places = np.ones(len(known), np.int64), np.zeros(len(known), np.int64)
        used = self.cache.used
        self.flat = np.concatenate([self.cache.flat[:used], self.v.whole_ids])
        places[known] = used + number[known]
        sizes[miss] = self.cache.sizes[entry]
        places[miss] = self.cache.starts[entry]
        return sizes, places

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the distinct pre-tokens, how often each occurs and its tokens; special tokens are not looked for."""
        starts, ends = pretoken_spans(data, offsets)
        keys, first, n = np.unique(span_hashes(data, starts, ends), return_index=True, return_counts=True)
        return keys, n, self._resolve(data, starts[first], ends[first], keys)[0]

    def counts(self, data: np.ndarray, offsets: np.ndarray, frequent: Lengths | None = None) -> np.ndarray:
        """Tokens of each text; those of pre-tokens in ``frequent`` are looked up there."""
        sizes, _, starts = self.pretokens(data, offsets, frequent)
        total = np.concatenate([[0], np.cumsum(sizes)])
        return np.diff(total[np.searchsorted(starts, offsets)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the bounds of each text's."""
        sizes, places, starts = self.pretokens(data, offsets)
        total = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[concat_ranges(places, sizes)], total[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids."""
        return self.v.blob[concat_ranges(self.v.offsets[ids], self.v.lengths[ids])]


_WORKER: dict = {}


def worker_encoder(broadcast, specials: bool, heap: bool) -> Encoder:
    """The encoder of this Python worker for a broadcast vocabulary; it outlives a task."""
    key = (broadcast.value.key, specials, heap)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Encoder(broadcast.value, specials, heap)
    return _WORKER[key]


@lru_cache(2)
def load(path: str) -> Vocabulary:
    out = Vocabulary.from_json(path) if path.endswith(".json") else Vocabulary.from_ranks(path)
    out.key = path
    return out

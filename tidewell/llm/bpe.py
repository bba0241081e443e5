"""Byte-level BPE encoding and decoding (operator 4).

Two tiers. A text is cut into pre-tokens by array operations over its code points. A minimal perfect
hash over the whole vocabulary answers for the pre-tokens that are tokens themselves; the answer counts
only if the stored bytes are the same. The others are merged with a heap over linked byte pieces, and a
bounded per-worker memory keeps the results of frequent ones.

Null texts count as empty and give no ids; an id outside the vocabulary is an error in decoding.
Every row is kept, repeated rows too; only the named text column is read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.textkit import GROUP_BYTES, binary_array, groups, pieces, utf8_views

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3

# The code points with the Unicode property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]

#: Remembered misses in each of the two generations of a worker's memory.
REMEMBERED = 250_000

_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash by displacement: buckets, largest first, look for a displacement that puts their keys on free slots."""

    def __init__(self, keys: np.ndarray):
        self.n, self.r = len(keys), max(1, len(keys) // 3)
        if not self.n:
            raise ValueError("no keys")
        buckets: list[list[int]] = [[] for _ in range(self.r)]
        for k, b in enumerate((keys % np.uint64(self.r)).tolist()):
            buckets[b].append(k)
        used, self.shift = np.zeros(self.n, bool), np.zeros(self.r, np.int64)
        self.slot_of = np.zeros(self.n, np.int64)
        order = sorted(range(self.r), key=lambda b: -len(buckets[b]))
        singles = [b for b in order if len(buckets[b]) == 1]
        for b in (b for b in order if len(buckets[b]) > 1):
            own, base, many = keys[buckets[b]], 0, 16
            while True:
                slots = self._slots(own[None, :], np.arange(base, base + many, dtype=np.uint64)[:, None])
                ordered = np.sort(slots, axis=1)
                good = ~used[slots].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if good.any():
                    k = int(good.argmax())
                    self.shift[b], self.slot_of[buckets[b]] = base + k, slots[k]
                    used[slots[k]] = True
                    break
                base, many = base + many, min(4 * many, 4096)
                if base > 1 << 26:
                    raise ValueError("two keys have the same hash")
        for b, free in zip(singles, np.flatnonzero(~used).tolist(), strict=True):
            self.shift[b], self.slot_of[buckets[b][0]] = -free - 1, free

    def _slots(self, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (_mix(keys + shift * _C) % np.uint64(self.n)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        shift = self.shift[(keys % np.uint64(self.r)).astype(np.int64)]
        return np.where(shift < 0, -shift - 1, self._slots(keys, shift.astype(np.uint64)))


def _key(token: bytes) -> int:
    low, high = (int.from_bytes(token[k : k + 8], "little") for k in (0, 8))
    rest = xxhash.xxh64_intdigest(token[16:]) if len(token) > 16 else 0
    return (low * int(_A) + high * int(_B) + len(token) * int(_C) + rest * int(_D)) % 2**64


class Vocabulary:
    """Ranks of a byte-level BPE; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.pairs = [-1] * 65536  # rank of each two bytes
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pairs[token[0] * 256 + token[1]] = rank
        tokens = list(ranks)
        self.hash = PerfectHash(_mix(np.array([_key(t) for t in tokens], np.uint64)))
        by_slot: list[bytes] = [b""] * len(tokens)
        for token, slot in zip(tokens, self.hash.slot_of.tolist(), strict=True):
            by_slot[slot] = token
        self.slot_token = by_slot
        self.slot_id = np.array([ranks[t] for t in by_slot], np.uint32)
        self.slot_size = np.array([len(t) for t in by_slot], np.int64)
        self.slot_low = np.array([int.from_bytes(t[:8], "little") for t in by_slot], np.uint64)
        self.slot_high = np.array([int.from_bytes(t[8:16], "little") for t in by_slot], np.uint64)
        top = max(ranks.values()) + 1
        sizes = np.zeros(top, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        self.id_size, self.id_start = sizes, np.concatenate(([0], np.cumsum(sizes)))[:-1]
        ordered = sorted(ranks.items(), key=lambda x: x[1])
        self.id_bytes = np.frombuffer(b"".join(t for t, _ in ordered), np.uint8)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @classmethod
    def from_file(cls, content: bytes) -> Vocabulary:
        """content: lines of a base64 token and its rank."""
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a})

    def __getstate__(self) -> dict:
        return self.__dict__ | {"young": {}, "old": {}}

    def find(self, token: bytes) -> int | None:
        """The id of a whole pre-token, by the perfect hash."""
        slot = int(self.hash(_mix(np.array([_key(token)], np.uint64)))[0])
        return int(self.slot_id[slot]) if self.slot_token[slot] == token else None

    def merged(self, token: bytes) -> list[int]:
        """Ids of a pre-token that is no token: the pair of lowest rank, leftmost first, is merged until none is left."""
        get, n, longest = self.ranks.get, len(token), self.longest
        shift = max(21, n.bit_length() + 1)
        mask = (1 << shift) - 1
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.pairs
        heap = [(((rank << shift) | i) << shift) | (i + 2) for i, (a, b) in enumerate(zip(token, token[1:], strict=False)) if (rank := pairs[a * 256 + b]) >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            stop, start = top & mask, (top >> shift) & mask
            middle = end[start]
            if not 0 < middle < stop or end[middle] != stop:
                continue
            end[start], end[middle] = stop, 0
            if stop < n:
                before[stop] = start
                if end[stop] - start <= longest:
                    rank = get(token[start : end[stop]])
                    if rank is not None:
                        push(heap, (((rank << shift) | start) << shift) | end[stop])
            if start and stop - before[start] <= longest:
                rank = get(token[before[start] : stop])
                if rank is not None:
                    push(heap, (((rank << shift) | before[start]) << shift) | stop)
        ids, i = [], 0
        while i < n:
            ids.append(get(token[i : end[i]]))
            i = end[i]
        return ids

    def missed(self, token: bytes) -> bytes:
        """Ids, as little-endian uint32, of a pre-token that the array lookup has not resolved."""
        got = self.young.get(token)
        if got is None:
            got = self.old.get(token)
            if got is None:
                whole = self.find(token) if len(token) > 16 else None
                got = np.array(self.merged(token) if whole is None else [whole], "<u4").tobytes()
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            if len(token) <= 256:
                self.young[token] = got
        return got

    def encoded(self, data: bytes, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their count in each text) of the texts that edges cut data into."""
        starts = pretoken_starts(data, edges)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(edges) - 1, np.int64)
        stops = np.append(starts[1:], len(data))
        size = stops - starts
        lanes = np.ndarray((len(data) + 8,), "<u8", data + bytes(24), 0, (1,))
        low = lanes[starts] & _LOW[np.minimum(size, 8)]
        high = lanes[np.minimum(starts + 8, len(data))] & _LOW[np.clip(size - 8, 0, 8)]
        slot = self.hash(_mix(low * _A + high * _B + size.astype(np.uint64) * _C))
        hit = (self.slot_size[slot] == size) & (self.slot_low[slot] == low) & (self.slot_high[slot] == high) & (size <= 16)
        miss = np.flatnonzero(~hit)
        missed = self.missed
        packed = [missed(data[a:b]) for a, b in zip(starts[miss].tolist(), stops[miss].tolist(), strict=True)]
        count = np.ones(len(starts), np.int64)
        count[miss] = np.fromiter(map(len, packed), np.int64, len(packed)) >> 2
        first = np.concatenate(([0], np.cumsum(count)))
        ids = np.empty(first[-1], np.uint32)
        from_miss = np.repeat(~hit, count)
        ids[~from_miss] = self.slot_id[slot[hit]]
        ids[from_miss] = np.frombuffer(b"".join(packed), "<u4")
        per_text = np.diff(first[np.searchsorted(starts, edges)])
        return ids, per_text

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets of the ids' parts in them)."""
        size = self.id_size[ids]
        offsets = np.concatenate(([0], np.cumsum(size)))
        return self.id_bytes[np.repeat(self.id_start[ids] - offsets[:-1], size) + np.arange(offsets[-1])], offsets


_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER of each code point, by the Unicode general category."""
    global _classes
    if _classes is None:
        kinds = {"L": LETTER, "N": NUMBER}
        _classes = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        _classes[WHITE_SPACE] = SPACE
    return _classes


def pretoken_starts(data: bytes, edges: np.ndarray) -> np.ndarray:
    """Byte offsets at which pre-tokens start in the texts that edges cut data into.

    A pre-token is an English contraction ending, a run of letters, of numbers or of other marks, each with
    one space before it if there is one, or white space; of white space before a visible character the last
    one stands apart.
    """
    points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    at = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))
    kind = char_classes()[points]
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(at, edges)] = True  # of each text
    first[n] = True
    run = first[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    blank = kind == SPACE
    after_blank = np.zeros(n, bool)
    after_blank[1:] = (points[:-1] == 32) & ~first[1:n]
    last_blank = blank.copy()
    last_blank[:-1] &= ~blank[1:]
    last_blank &= ~first[1:]
    starts = np.where(blank, run | last_blank, run & ~after_blank)
    mark = np.flatnonzero((points == 39) & starts & run)
    mark = mark[mark + 1 < n]
    mark = mark[~first[mark + 1]]
    one = points[mark + 1]
    single = np.isin(one, [ord(c) for c in "stmd"])
    pair = mark + 2 < n
    pair[pair] = ~first[mark[pair] + 2]
    two = np.where(pair, points[np.minimum(mark + 2, n - 1)], 0)
    double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    for found, length in ((single, 2), (double & ~single, 3)):
        starts[mark[found] + 1] = False
        rest = mark[found] + length
        starts[rest[rest < n]] = True
    return at[np.flatnonzero(starts)]


def load_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary for executors: one file of a tokenizer, whose size does not depend on the data."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(Vocabulary.from_file(file.read()))


def encode(vocabulary: Broadcast, text: Column) -> Column:
    """Ids of a text as packed little-endian uint32."""

    @F.arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            data, offsets = utf8_views(column)
            parts, sizes = [], np.zeros(len(column) + 1, np.int64)
            for i, j in groups(offsets, GROUP_BYTES // 2):
                raw = data[offsets[i] : offsets[j]].tobytes()
                if j == i + 1:  # maybe a long text; a pre-token ends before each space that follows a visible character
                    for piece in pieces(raw):
                        got, _ = vocabulary.value.encoded(piece, np.array([0, len(piece)]))
                        parts.append(got.astype("<u4", copy=False).tobytes())
                        sizes[j] += len(parts[-1])
                    continue
                got, count = vocabulary.value.encoded(raw, offsets[i : j + 1] - offsets[i])
                parts.append(got.astype("<u4", copy=False).tobytes())
                sizes[i + 1 : j + 1] = 4 * count
            packed = b"".join(parts)
            del parts
            yield binary_array(np.frombuffer(packed, np.uint8), np.cumsum(sizes))

    return ids(text)


def decode(vocabulary: Broadcast, ids: Column) -> Column:
    """Bytes of packed ids."""

    @F.arrow_udf("binary")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            data, offsets = utf8_views(column)
            parts, edges = [], np.zeros(len(column) + 1, np.int64)
            for i, j in groups(offsets, GROUP_BYTES // 2):
                ids = np.frombuffer(data[offsets[i] : offsets[j]].tobytes(), "<u4")
                if j == i + 1:
                    parts += [vocabulary.value.decoded(ids[k : k + GROUP_BYTES])[0].tobytes() for k in range(0, len(ids), GROUP_BYTES)]
                    edges[j] = edges[i] + vocabulary.value.id_size[ids].sum()
                    continue
                got, at = vocabulary.value.decoded(ids)
                parts.append(got.tobytes())
                edges[i + 1 : j + 1] = at[(offsets[i + 1 : j + 1] - offsets[i]) >> 2] + edges[i]
            packed = b"".join(parts)
            del parts
            yield binary_array(np.frombuffer(packed, np.uint8), edges)

    return text(ids)

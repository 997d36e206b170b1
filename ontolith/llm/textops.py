"""Vectorised byte-level text primitives shared by the operators.

Texts arrive as Arrow string arrays and are handled as one flat UTF-8 buffer
plus offsets, a few megabytes at a time, so that memory stays bounded however
many rows an Arrow batch has. Words are identified by 64-bit hashes; where a
hash decides something global, two independent ones are used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 3 << 20

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_STEP = U(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE

ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        base = np.full(max(n, 2 * len(_powers)), _STEP, dtype=np.uint64)
        base[0] = 1
        _powers = np.multiply.accumulate(base)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def seeded(seed: int) -> np.uint64:
    return mix(np.array([(seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64], dtype=np.uint64))[0]


@dataclass
class Texts:
    """Flat bytes of some texts; text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    #: words of text i are first[i]:first[i + 1]
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)


def flat(column: pa.Array) -> Texts:
    """Nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return Texts(data, off - off[0])


def slices(column: pa.Array, most: int = SLICE_BYTES):
    """Yields (start, stop) row ranges of at most so many bytes; a longer text stands alone."""
    if not len(column):
        return
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, held = 0, 0
    for i, s in enumerate(sizes):
        if held and held + s > most:
            yield begin, i
            begin, held = i, 0
        held += int(s)
    yield begin, len(sizes)


def split(t: Texts, member: np.ndarray, lower: bool = False) -> Words:
    """Maximal runs of bytes of a class, never across texts."""
    n = len(t.data)
    if not n:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(t) + 1, np.int64))
    mask = member[LOWER[t.data]] if lower else member[t.data]
    bounds = t.offsets[:-1][np.diff(t.offsets) > 0]
    edge = np.zeros(n, bool)
    edge[bounds] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    start = np.flatnonzero(mask & (edge | ~before))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    after[bounds[1:] - 1] = False
    end = np.flatnonzero(mask & ~after) + 1
    return Words(start, end, np.searchsorted(start, t.offsets))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans must not be empty."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    at = np.zeros(len(size), np.int64)
    np.cumsum(size[:-1], out=at[1:])
    inside = np.arange(int(size.sum())) - np.repeat(at, size)
    value = _BYTE[data[inside + np.repeat(start, size)]]
    value *= powers(int(size.max()))[inside]
    return mix(np.add.reduceat(value, at) + size.astype(np.uint64))


def word_hashes(t: Texts, w: Words, lower: bool = False) -> np.ndarray:
    return span_hash(LOWER[t.data] if lower else t.data, w.start, w.end)


def windows(h: np.ndarray, first: np.ndarray, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words inside one text, and the bounds of each text's windows."""
    n = len(h)
    count = np.maximum(np.diff(first) - (k - 1), 0)
    bounds = np.zeros(len(first), np.int64)
    np.cumsum(count, out=bounds[1:])
    if n < k or not bounds[-1]:
        return np.zeros(0, np.uint64), bounds
    total = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        total += mix(h[j : n - k + 1 + j] + seeded(salt * 64 + j))* U(2 * j + 1)
    keep = np.zeros(n - k + 1, bool)
    starts = np.repeat(first[:-1] - bounds[:-1], count) + np.arange(int(bounds[-1]))
    keep[starts] = True
    return mix(total[keep]), bounds


def repeated(keys: np.ndarray) -> np.ndarray:
    """For each key, whether it occurs twice or more."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    return member(keys, twice)


def member(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Whether each key is in the sorted array."""
    if not len(found):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(found, keys)
    at[at == len(found)] = 0
    return found[at] == keys


class Table:
    """An open-addressing map from 64-bit keys to row numbers, looked up by arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 3 // 2).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        left, probe = np.arange(len(keys)), 0
        home = self._home(keys)
        while len(left):
            slot = (home[left] + probe) & (len(self.keys) - 1)
            free = self.rows[slot] < 0
            self.rows[slot[free]] = left[free]
            won = self.rows[slot] == left
            self.keys[slot[won]] = keys[left[won]]
            left, probe = left[~won], probe + 1

    def _home(self, keys):
        return ((keys * _STEP) >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where absent."""
        home = self._home(keys)
        got, row = self.keys[home], self.rows[home]
        out = np.where((got == keys) & (row >= 0), row, -1)
        left = np.flatnonzero((got != keys) & (row >= 0))
        probe = 1
        while len(left):
            slot = (home[left] + probe) & (len(self.keys) - 1)
            got, row = self.keys[slot], self.rows[slot]
            hit = (got == keys[left]) & (row >= 0)
            out[left[hit]] = row[hit]
            left, probe = left[~hit & (row >= 0)], probe + 1
        return out

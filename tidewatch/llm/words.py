"""Words of whole Arrow text columns as flat numpy arrays.

A word is a maximal run of bytes other than space, tab, line feed, vertical
tab, form feed and carriage return, which on UTF-8 is ``[^\\x20\\x09-\\x0D]+``.
Nothing here loops over words in Python: a batch is one byte array with
offsets, as Arrow holds it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
HASH_BLOCK = 1 << 18


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads every input bit over all output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, where one of each stands, and each element's place among them.

    As ``np.unique`` with index and inverse, without its stable sort.
    """
    if not len(x):
        return x, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(x)
    ordered = x[order]
    new = np.empty(len(x), bool)
    new[0], new[1:] = True, ordered[1:] != ordered[:-1]
    back = np.empty(len(x), np.int64)
    back[order] = np.cumsum(new) - 1
    return ordered[new], order[new], back


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def odd(seed: int) -> int:
    return int(np.random.default_rng(seed).integers(1, 2**63, dtype=np.uint64)) | 1


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


@dataclass
class Flat:
    """Texts as one byte array: text ``i`` is ``data[offsets[i]:offsets[i + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


def flat(column: pa.Array) -> Flat:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    n = len(column)
    if n == 0 or where is None:
        return Flat(np.zeros(0, np.uint8), np.zeros(n + 1, np.int64))
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Flat(raw[offsets[0]:offsets[-1]], offsets - offsets[0])


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES):
    """Parts of a batch with at most ``most`` text bytes each (a longer text alone)."""
    offsets = flat(batch.column(column)).offsets
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


@dataclass
class Words:
    """Word ``j`` is ``data[start[j]:end[j]]``; text ``i`` has words ``bounds[i]:bounds[i + 1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())


def words(texts: Flat, lower: bool = False) -> Words:
    data, offsets = texts.data, texts.offsets
    if lower:
        upper = (data >= 65) & (data <= 90)
        data = np.where(upper, data + 32, data).astype(np.uint8) if upper.any() else data
    inside = (data != 32) & ((data < 9) | (data > 13))
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(inside):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        before[cut] = False
        after[cut - 1] = False
    start = np.flatnonzero(inside & ~before)
    return Words(data, start, np.flatnonzero(inside & ~after) + 1, np.searchsorted(start, offsets))


def hashes(w: Words, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums of a random polynomial."""
    out = np.empty(len(w.start), np.uint64)
    base, table = odd(seed + 1000), _table(seed)
    up, down = powers(base, HASH_BLOCK), powers(inverse(base), HASH_BLOCK)
    at = 0
    while at < len(out):
        first = w.start[at]
        to = max(at + 1, int(np.searchsorted(w.end, first + HASH_BLOCK, "right")))
        seg = w.data[first:w.end[to - 1]]
        if len(seg) > len(up):
            up, down = powers(base, len(seg)), powers(inverse(base), len(seg))
        total = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(table[seg] * up[:len(seg)], out=total[1:])
        s, e = w.start[at:to] - first, w.end[at:to] - first
        out[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out


def windows(h: np.ndarray, bounds: np.ndarray, n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``n``-word windows that stay within one text, and their first words.

    Short windows (shingles) and long ones cost the same: both come from prefix sums.
    """
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    base = odd(seed + 2000)
    got, where = [], []
    block = max(HASH_BLOCK // 4, 2 * n)
    up, down = powers(base, block + n), powers(inverse(base), block + n)
    last = np.repeat(bounds[1:], np.diff(bounds)) - n
    for at in range(0, len(h) - n + 1, block):
        seg = h[at:at + block + n - 1]
        total = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(seg * up[:len(seg)], out=total[1:])
        value = mix((total[n:] - total[:-n]) * down[:len(seg) - n + 1])
        first = np.arange(at, at + len(value))
        keep = first <= last[first]
        got.append(value[keep])
        where.append(first[keep])
    return np.concatenate(got), np.concatenate(where)

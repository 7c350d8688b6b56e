"""Token-ID files of patched frame-of-reference blocks.

A file holds one run of whole documents in ascending order::

    magic      8 bytes   b"PFORIDS1"
    header     5 x u64   block size, documents, ids, ids before this file in its part, blocks
    doc ids    i64 each  document ids, in file order
    lengths    u64 each  ids of each document
    index      u64 each  start of each block counted from the first block's byte, and the end
    blocks               minimum u32, width u8, exceptions u16, packed values,
                         exception places u16 each, exception values u32 each

A block holds up to ``block size`` ids. Its minimum is subtracted, and the rest packed at the bit
width that holds ``PERCENT`` % of them; the others are exceptions, stored whole (their packed bits
are 0). The last block of a file is padded with its own minimum. All numbers are little-endian.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"PFORIDS1"
BLOCK = 256
PERCENT = 95
HEAD = np.dtype([("minimum", "<u4"), ("width", "u1"), ("n", "<u2")])


def _ragged(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places first[i], first[i] + 1, ... of every stretch, one stretch after another."""
    before = np.cumsum(length) - length
    return np.repeat(first - before, length) + np.arange(int(length.sum()))


def pack_blocks(ids: np.ndarray, block: int = BLOCK, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all blocks, and where each begins (with the end)."""
    n = -(-len(ids) // block)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    full = np.empty(n * block, np.int64)
    full[:len(ids)] = ids
    full[len(ids):] = ids[(n - 1) * block:].min()
    full = full.reshape(n, block)
    least = full.min(axis=1)
    rest = full - least[:, None]
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.int64)
    width = np.sort(bits, axis=1)[:, -(-block * percent // 100) - 1]
    odd = bits > width[:, None]
    n_odd = odd.sum(axis=1)
    packed = -(-block * width // 8)
    size = HEAD.itemsize + packed + n_odd * 6
    start = np.append(0, np.cumsum(size))
    out = np.zeros(start[-1], np.uint8)
    head = np.zeros(n, HEAD)
    head["minimum"], head["width"], head["n"] = least, width, n_odd
    out[start[:-1, None] + np.arange(HEAD.itemsize)] = head.view(np.uint8).reshape(n, -1)
    rest[odd] = 0
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        for at in range(0, len(rows), 2048):
            some = rows[at:at + 2048]
            raw = rest[some].astype("<u4").view(np.uint8).reshape(len(some), block, 4)
            flags = np.unpackbits(raw, axis=2, bitorder="little")[:, :, :w].reshape(len(some), -1)
            out[start[some][:, None] + HEAD.itemsize + np.arange(packed[some[0]])] = np.packbits(flags, axis=1, bitorder="little")
    at = start[:-1] + HEAD.itemsize + packed
    where = np.nonzero(odd)
    out[_ragged(at, n_odd * 2)] = where[1].astype("<u2").view(np.uint8)
    out[_ragged(at + n_odd * 2, n_odd * 4)] = full[where].astype("<u4").view(np.uint8)
    return out, start


def unpack_blocks(data: np.ndarray, start: np.ndarray, n_ids: int, block: int = BLOCK) -> np.ndarray:
    n = len(start) - 1
    out = np.empty((n, block), np.uint32)
    head = np.ascontiguousarray(data[start[:-1, None] + np.arange(HEAD.itemsize)]).view(HEAD).reshape(n)
    width, n_odd = head["width"].astype(np.int64), head["n"].astype(np.int64)
    packed = -(-block * width // 8)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        for at in range(0, len(rows), 2048):
            some = rows[at:at + 2048]
            value = np.zeros((len(some), block, 4), np.uint8)
            if w:
                flags = np.unpackbits(data[start[some][:, None] + HEAD.itemsize + np.arange(packed[some[0]])], axis=1, bitorder="little")
                wide = np.zeros((len(some), block, 32), np.uint8)
                wide[:, :, :w] = flags[:, :block * w].reshape(len(some), block, w)
                value = np.packbits(wide, axis=2, bitorder="little")
            out[some] = np.ascontiguousarray(value).view("<u4")[:, :, 0] + head["minimum"][some][:, None]
    at = start[:-1] + HEAD.itemsize + packed
    place = data[_ragged(at, n_odd * 2)].view("<u2")
    out[np.repeat(np.arange(n), n_odd), place] = data[_ragged(at + n_odd * 2, n_odd * 4)].view("<u4")
    return out.reshape(-1)[:n_ids]


def write(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, before: int) -> bytes:
    """One whole file; ``before`` counts the ids of earlier files of the same part."""
    blocks, start = pack_blocks(ids)
    head = struct.pack("<5Q", BLOCK, len(doc_ids), len(ids), before, len(start) - 1)
    return b"".join([MAGIC, head, np.asarray(doc_ids, "<i8").tobytes(), np.asarray(lengths, "<u8").tobytes(),
                     start.astype("<u8").tobytes(), blocks.tobytes()])


def read(file: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """``(doc ids, lengths, ids, ids before this file in its part)``."""
    if file[:8] != MAGIC:
        raise ValueError("not a token-id file")
    block, n_docs, n_ids, before, n_blocks = struct.unpack_from("<5Q", file, 8)
    at = 48
    doc_ids = np.frombuffer(file, "<i8", n_docs, at)
    lengths = np.frombuffer(file, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
    start = np.frombuffer(file, "<u8", n_blocks + 1, at + 16 * n_docs).astype(np.int64)
    data = np.frombuffer(file, np.uint8, offset=at + 16 * n_docs + 8 * (n_blocks + 1))
    return doc_ids, lengths, unpack_blocks(data, start, n_ids, block), before


def read_block(file: bytes, k: int) -> np.ndarray:
    """The ids of block ``k`` alone, found by the index of block starts."""
    block, n_docs, n_ids, _, n_blocks = struct.unpack_from("<5Q", file, 8)
    at = 48 + 16 * n_docs
    a, b = struct.unpack_from("<2Q", file, at + 8 * k)
    data = np.frombuffer(file, np.uint8, b - a, at + 8 * (n_blocks + 1) + a)
    return unpack_blocks(data, np.array([0, b - a]), min(block, n_ids - k * block), block)

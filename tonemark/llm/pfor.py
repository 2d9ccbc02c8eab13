"""Patched frame-of-reference blocks of unsigned 32-bit integers.

A block holds 256 integers: the block minimum is subtracted, the low `width` bits of the
differences are packed, and what is higher goes to an exception list. The width is that
of the percentile of the block's differences that gives the shortest block. Layout,
little-endian:

    minimum u32 | width u8 | zero u8 | exceptions u16 | 4 * width words u64
    | exception positions u8 * n | high bits of exceptions u32 * n

Integers are laid in 64 rows of 4; word j of each of the four columns takes the bits
64j..64j+63 of that column's 64 packed integers. The last block is filled with its
minimum; the reader knows the number of integers.
"""

from __future__ import annotations

import numpy as np

BLOCK = 256
PERCENTILES = (50, 75, 90, 95, 98, 100)
HEADER = 8


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 256) integers below 2**width as (blocks, 32 * width) bytes."""
    lanes = values.astype(np.uint64).reshape(-1, 64, 4).transpose(1, 0, 2)
    words = np.zeros((width, lanes.shape[1], 4), np.uint64)
    for lane in range(64):
        word, shift = divmod(lane * width, 64)
        words[word] |= lanes[lane] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lanes[lane] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.transpose(1, 0, 2)).view(np.uint8).reshape(len(values), 32 * width)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(packed).view("<u8").reshape(-1, width, 4).transpose(1, 0, 2)
    lanes = np.empty((64, words.shape[1], 4), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for lane in range(64):
        word, shift = divmod(lane * width, 64)
        value = words[word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (words[word + 1] << np.uint64(64 - shift))
        lanes[lane] = value & mask
    return lanes.transpose(1, 0, 2).reshape(-1, BLOCK)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all blocks, and where each block starts."""
    if not len(ids):
        return np.zeros(0, np.uint8), np.zeros(0, np.int32)
    n = -(-len(ids) // BLOCK)
    full = np.empty(n * BLOCK, np.int64)
    full[: len(ids)] = ids
    full[len(ids) :] = ids[(n - 1) * BLOCK :].min()
    full = full.reshape(n, BLOCK)
    least = full.min(axis=1)
    rel = full - least[:, None]
    order = np.sort(rel, axis=1)
    ranks = [max(0, BLOCK * p // 100 - 1) for p in PERCENTILES]
    widths = np.ceil(np.log2(order[:, ranks] + 1.0)).astype(np.int64)
    sizes = np.empty_like(widths)
    for k in range(len(PERCENTILES)):
        sizes[:, k] = 32 * widths[:, k] + 5 * (rel >= (1 << widths[:, k])[:, None]).sum(axis=1)
    width = widths[np.arange(n), sizes.argmin(axis=1)]
    high = rel >> width[:, None]
    counts = (high > 0).sum(axis=1)
    lengths = HEADER + 32 * width + 5 * counts
    starts = np.cumsum(lengths) - lengths
    out = np.zeros(int(lengths.sum()), np.uint8)
    head = np.zeros((n, HEADER), np.uint8)
    head[:, :4] = least.astype("<u4").view(np.uint8).reshape(n, 4)
    head[:, 4] = width
    head[:, 6:8] = counts.astype("<u2").view(np.uint8).reshape(n, 2)
    out[starts[:, None] + np.arange(HEADER)] = head
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        at = starts[rows, None] + HEADER + np.arange(32 * w)
        out[at] = _pack(rel[rows] & ((1 << int(w)) - 1), int(w))
    row, col = np.nonzero(high)
    rank = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    lists = starts[row] + HEADER + 32 * width[row]
    out[lists + rank] = col
    above = high[row, col].astype("<u4").view(np.uint8).reshape(-1, 4)
    out[(lists + counts[row] + 4 * rank)[:, None] + np.arange(4)] = above
    return out, starts.astype(np.int32)


def unpack(data: np.ndarray, starts: np.ndarray, n_ids: int) -> np.ndarray:
    """All integers of the blocks at `starts`."""
    if not n_ids:
        return np.zeros(0, np.uint32)
    starts = starts.astype(np.int64)
    head = data[starts[:, None] + np.arange(HEADER)]
    least = np.ascontiguousarray(head[:, :4]).view("<u4").ravel()
    width = head[:, 4].astype(np.int64)
    counts = np.ascontiguousarray(head[:, 6:8]).view("<u2").ravel().astype(np.int64)
    rel = np.zeros((len(starts), BLOCK), np.uint64)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        rel[rows] = _unpack(data[starts[rows, None] + HEADER + np.arange(32 * w)], int(w))
    row = np.repeat(np.arange(len(starts)), counts)
    rank = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    lists = starts[row] + HEADER + 32 * width[row]
    above = np.ascontiguousarray(data[(lists + counts[row] + 4 * rank)[:, None] + np.arange(4)])
    rel[row, data[lists + rank]] |= above.view("<u4").ravel().astype(np.uint64) << width[row].astype(np.uint64)
    return (rel + least[:, None]).astype(np.uint32).ravel()[:n_ids]

"""Hashes of the words and word shingles of many whole texts at once.

A word is a maximal run of ASCII letters and digits and of bytes above 127 of the
lower-cased text in UTF-8.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5
CHUNK_BYTES = 1 << 21
_M = 0xFFFFFFFFFFFFFFFF
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Word hashes of the texts in order, and how many each text has."""

    def __init__(self) -> None:
        self.power, self.inverse = _powers(_BASE, CHUNK_BYTES), _powers(_INVERSE, CHUNK_BYTES)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [t.lower().encode("utf-8", "replace") for t in texts]
        parts, counts, begin = [], [], 0
        while begin < len(raw):
            end, held = begin, 0
            while end < len(raw) and (end == begin or held + len(raw[end]) + 1 <= CHUNK_BYTES):
                held += len(raw[end]) + 1
                end += 1
            hashes, n = self._chunk(raw[begin:end])
            parts.append(hashes)
            counts.append(n)
            begin = end
        if not parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate(parts), np.concatenate(counts)

    def _chunk(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        if len(data) > len(self.power):  # one text longer than a chunk
            self.power, self.inverse = _powers(_BASE, len(data)), _powers(_INVERSE, len(data))
        edges = np.flatnonzero(np.diff(_IS_WORD[data].astype(np.int8), prepend=np.int8(0)))
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.power[: len(data)], out=sums[1:])
        hashes = mixed((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))
        bounds = np.cumsum([len(r) + 1 for r in raw])
        upto = np.searchsorted(starts, bounds)
        return hashes, np.diff(upto, prepend=0)


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in order, and how many each text has.

    A text of fewer words than `size` has one shingle of all its words; one without words
    has none.
    """
    ends = np.cumsum(counts)
    begins = ends - counts
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    first = np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    length = np.repeat(np.minimum(counts, size), n)
    out = length.astype(np.uint64)
    for k in range(size):
        inside = length > k
        value = hashes[np.minimum(first + k, len(hashes) - 1)] if len(hashes) else hashes
        out = np.where(inside, out * _STEP + value, out)
    return mixed(out), n

"""Exact medians of all dimensions of a vector column by radix selection.

Values become unsigned integers of the same order. A pass counts, in one array per task, the
next bits of the values that share the bits found so far with a wanted rank, for all
dimensions at once; the counts say which bits come next. When few values are left they
are gathered. No row per clip and dimension is made, and what moves is bounded by the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Values of all dimensions together that may be gathered on the driver (12 bytes each).
GATHERED = 500_000
_SIGN = np.uint64(1 << 63)
_ALL = np.uint64(2**64 - 1)


def ordered(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; both zeros are one."""
    bits = (values + 0.0).view(np.uint64)
    return bits ^ np.where(bits >= _SIGN, _ALL, _SIGN)


def unordered(keys: np.ndarray) -> np.ndarray:
    """The doubles of ordered integers."""
    return (keys ^ np.where(keys >= _SIGN, _SIGN, _ALL)).view(np.float64)


def _flat(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and key of every value that is neither NULL nor NaN."""
    column = column.drop_null()
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    dims = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    known = ~np.isnan(values) & (dims < width)
    return dims[known], ordered(values[known])


def _among(dims: np.ndarray, keys: np.ndarray, prefix: np.ndarray, used: int) -> np.ndarray:
    """Values whose first `used` bits are those of their dimension's rank."""
    if used == 0:
        return np.ones(len(keys), bool)
    return keys >> np.uint64(64 - used) == prefix[dims]


def vector_medians(
    rows: DataFrame, width: int, features: str = "features", *, gathered: int = GATHERED, digit: int | None = None
) -> list[float | None]:
    """The interpolated median of each dimension; None for one without values.

    NULL vectors, NULL and NaN entries and entries past `width` count for nothing. At most
    64 / `digit` counting passes (`digit` bits each: 10, or 8 above 256 dimensions) and one that
    gathers read the vectors, which are kept between passes as a cache. The driver holds two
    counters per dimension and digit, and at most `gathered` values.
    """
    digit = digit or (10 if width <= 256 else 8)
    vectors = rows.select(F.col(features).cast("array<double>").alias("v")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _select(vectors, width, gathered, digit)
    finally:
        vectors.unpersist()


def _select(vectors: DataFrame, width: int, gathered: int, digit: int) -> list[float | None]:
    prefix, ranks = np.zeros((2, width), np.uint64), np.zeros((2, width), np.int64)
    used, sizes = 0, None
    while used < 64:
        bits = min(digit, 64 - used)
        counts = _count(vectors, width, prefix, used, bits)
        if sizes is None:
            sizes = counts[0].sum(axis=1)
            ranks = np.stack([np.maximum(sizes - 1, 0) // 2, sizes // 2])
        upto = counts.cumsum(axis=2)
        at = (upto <= ranks[:, :, None]).sum(axis=2)
        at = np.minimum(at, (1 << bits) - 1)
        here = np.take_along_axis(counts, at[:, :, None], 2)[:, :, 0]
        ranks = ranks - (np.take_along_axis(upto, at[:, :, None], 2)[:, :, 0] - here)
        prefix = (prefix << np.uint64(bits)) | at.astype(np.uint64)
        used += bits
        if used < 64 and here.sum() <= gathered:
            prefix = _gather(vectors, width, prefix, used, ranks, sizes)
            break
    low, high = unordered(prefix[0]), unordered(prefix[1])
    return [float(a + (b - a) * 0.5 if a != b else a) if n else None for a, b, n in zip(low, high, sizes, strict=True)]


def _count(vectors: DataFrame, width: int, prefix: np.ndarray, used: int, bits: int) -> np.ndarray:
    """(rank, dimension, digit) counts of the values under each prefix."""
    one = bool((prefix[0] == prefix[1]).all())
    shift, mask, cells = np.uint64(64 - used - bits), np.uint64((1 << bits) - 1), width << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((1 if one else 2, cells), np.int64)
        for batch in batches:
            dims, keys = _flat(batch.column(0), width)
            for r in range(len(counts)):
                mine = _among(dims, keys, prefix[r], used)
                cell = (dims[mine] << bits) + ((keys[mine] >> shift) & mask).astype(np.int64)
                counts[r] += np.bincount(cell, minlength=cells)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(counts.ravel()[full])], ["cell", "n"])

    found = vectors.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((1 if one else 2) * cells, np.int64)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    out = out.reshape(-1, width, 1 << bits)
    return np.concatenate([out, out]) if one else out


def _gather(
    vectors: DataFrame, width: int, prefix: np.ndarray, used: int, ranks: np.ndarray, sizes: np.ndarray
) -> np.ndarray:
    """The keys at the wanted ranks among the values under each prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, keys = _flat(batch.column(0), width)
            mine = _among(dims, keys, prefix[0], used) | _among(dims, keys, prefix[1], used)
            yield pa.RecordBatch.from_arrays(
                [pa.array(dims[mine].astype(np.int32)), pa.array(keys[mine].view(np.int64))], ["dim", "key"]
            )

    left = vectors.mapInArrow(run, "dim int, key bigint").toArrow()
    dims, keys = left.column("dim").to_numpy(), left.column("key").to_numpy().view(np.uint64)
    out = np.zeros_like(prefix)
    for d in np.flatnonzero(sizes):
        own = keys[dims == d]
        for r in (0, 1):
            under = np.sort(own[_among(np.zeros(len(own), int), own, prefix[r, d : d + 1], used)])
            out[r, d] = under[ranks[r, d]]
    return out

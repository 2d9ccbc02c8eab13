"""Operator 6: documents cut into pieces and packed into sequences by differencing.

A document is its ids and an end id. Pieces of full length are sequences of their own.
The rest of each document goes, in blocks of bounded size, through Karmarkar-Karp
multiway differencing: every piece starts as a partition of one filled window, the two
partitions with the largest spread merge, the fullest window of one with the emptiest of
the other, until one is left with near-equal windows. If a window exceeds the capacity,
the number of windows rises. Where that would pad more than `PADDING` of a block, its
longest pieces are cut, a quarter shorter each time, at most down to `SHORTEST`.

Blocks are packed in the task that encodes them: one pass over the table, no shuffle,
memory bounded by the block. Defined results: a null or empty text is its end id alone;
repeated doc_ids are packed like others; an empty table gives no rows; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemark.llm import tokens
from tonemark.llm.common import doc_rows

CAPACITY = 2048
BLOCK_PIECES = 512
PADDING = 0.02
SHORTEST = 128
_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("ids", pa.binary()),
    ]
)
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)


def difference(lengths: np.ndarray, windows: int) -> tuple[np.ndarray, int]:
    """A window for each length, and the fullest window's sum."""
    if windows == 1 or len(lengths) == 1:
        return np.zeros(len(lengths), np.int64), int(lengths.sum())
    sums = []
    for x in lengths:
        first = np.zeros(windows, np.int64)
        first[0] = x
        sums.append(first)
    # Nodes of the merge tree: (left, right, order of the merged windows).
    merges: list[tuple[int, int, np.ndarray] | None] = [None] * len(lengths)
    heap = [(-int(x), i) for i, x in enumerate(lengths)]
    heapq.heapify(heap)
    while len(heap) > 1:
        left, right = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        merged = sums[left] + sums[right][::-1]
        order = np.argsort(-merged, kind="stable")
        merged = merged[order]
        sums[left] = sums[right] = None
        sums.append(merged)
        merges.append((left, right, order))
        heapq.heappush(heap, (int(merged[-1] - merged[0]), len(sums) - 1))
    found = np.empty(len(lengths), np.int64)
    names: list[np.ndarray | None] = [None] * len(merges)
    names[-1] = np.arange(windows)
    for node in range(len(merges) - 1, -1, -1):
        if merges[node] is None:
            found[node] = names[node][0]
        else:
            left, right, order = merges[node]
            before = np.empty(windows, np.int64)
            before[order] = names[node]
            names[left], names[right] = before, before[::-1]
        names[node] = None
    return found, int(sums[-1][0])


def windows_of(lengths: np.ndarray, capacity: int, most: int | None = None) -> np.ndarray | None:
    """Windows for the lengths, as few as differencing can fill; None if over `most`."""
    count = -(-int(lengths.sum()) // capacity)
    while most is None or count <= most:
        found, fullest = difference(lengths, count)
        if fullest <= capacity:
            return found
        count += max(1, count // 100)
    return None


def packed(pieces: list[tuple[int, int, int]], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(document, start, length) as (document, start, length, window), cut where needed."""
    total = sum(x[2] for x in pieces)
    most = max(-(-total // capacity), int(total / capacity * (1 + PADDING)))
    longest = capacity
    while True:
        last = longest * 3 // 4 < SHORTEST
        found = windows_of(np.array([x[2] for x in pieces]), capacity, None if last else most)
        if found is not None:
            return [(*x, int(w)) for x, w in zip(pieces, found, strict=True)]
        longest = longest * 3 // 4
        pieces = [
            (doc, start + at, min(longest, length - at))
            for doc, start, length in pieces
            for at in range(0, length, longest)
        ]


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    vocabulary: str = tokens.VOCABULARY,
    end_id: int = 1,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, and its ids.

    sequence_id is unique and ascending within a task, not gapless over the table.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple[int | None, bytes]] = []
        rests: list[tuple[int, int, int]] = []
        rows: list[tuple] = []

        def row(doc, start, length, at, offset):
            doc_id, data = held[doc]
            part = data[4 * start : 4 * (start + length)]
            return (doc_id, start, length, zlib.crc32(part), len(data) // 4, at, offset, part if with_ids else None)

        def closed():
            nonlocal sequence
            if rests:
                filled: dict[int, int] = {}
                names: dict[int, int] = {}
                for doc, start, length, window in packed(rests, capacity):
                    at = names.setdefault(window, sequence + len(names))
                    rows.append(row(doc, start, length, at, filled.get(window, 0)))
                    filled[window] = filled.get(window, 0) + length
                sequence += len(names)
            held.clear()
            rests.clear()
            if rows:
                yield pa.record_batch(
                    [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES
                )
                rows.clear()

        for some, encoded in tokens.encoded_batches(batches, vocabulary):
            for doc_id, data in zip(some, encoded, strict=True):
                held.append((doc_id, data + end))
                count = len(data) // 4 + 1
                for start in range(0, count - capacity + 1, capacity):
                    rows.append(row(len(held) - 1, start, capacity, sequence, 0))
                    sequence += 1
                if rest := count % capacity:
                    rests.append((len(held) - 1, count - rest, rest))
                if len(rests) >= BLOCK_PIECES:
                    yield from closed()
        yield from closed()

    out = doc_rows(docs).select(F.col("doc_id"), F.col("text")).mapInArrow(run, PIECES)
    return out if with_ids else out.drop("ids")

"""Operator 1: token ids of documents in files of patched frame-of-reference blocks.

`write` deals documents over range partitions of doc_id, encodes each partition in
ascending order and writes pages of whole documents: the packed blocks (`pfor`), the
starts of the blocks, and ids and token counts of the page's documents. One partition is
one shard; shard, page and the number of ids before the page place every document. The
container is Parquet, so Spark commits the files and any store it can reach will do.
`read` decodes pages where they lie, without a shuffle.

Defined results: a null or empty text is its end id alone; equal doc_ids stand next to
each other, ordered by text; a null doc_id sorts first; an empty table gives no pages;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonemark.llm import pfor, tokens
from tonemark.llm.common import doc_rows

PAGE_IDS = 1 << 18
PAGES = (
    "shard int, page int, first long, doc_ids array<long>, doc_tokens array<int>, "
    "n_ids int, block_starts array<int>, payload binary"
)
_PAGES = pa.schema(
    [
        ("shard", pa.int32()),
        ("page", pa.int32()),
        ("first", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_tokens", pa.list_(pa.int32())),
        ("n_ids", pa.int32()),
        ("block_starts", pa.list_(pa.int32())),
        ("payload", pa.binary()),
    ]
)
_DOCS = pa.schema(
    [
        ("shard", pa.int32()),
        ("before", pa.int64()),
        ("doc_id", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("ids", pa.binary()),
    ]
)


def write(docs: DataFrame, path: str, vocabulary: str = tokens.VOCABULARY, end_id: int = 2) -> None:
    """Encode every whole text, append `end_id`, write pages in ascending doc_id order."""
    end = np.array([end_id], "<u4").tobytes()

    def pages(batches):
        shard, page, first = TaskContext.get().partitionId(), 0, 0
        ids, counts, parts, held = [], [], [], 0

        def closed():
            stream = np.frombuffer(b"".join(parts), "<u4")
            data, starts = pfor.pack(stream)
            row = [shard, page, first, ids, counts, len(stream), starts, data.tobytes()]
            return pa.record_batch([pa.array([x], f.type) for x, f in zip(row, _PAGES, strict=True)], schema=_PAGES)

        for some, encoded in tokens.encoded_batches(batches, vocabulary):
            for doc_id, data in zip(some, encoded, strict=True):
                ids.append(doc_id)
                counts.append(len(data) // 4 + 1)
                parts += (data, end)
                held += counts[-1]
                if held >= PAGE_IDS:
                    yield closed()
                    page, first = page + 1, first + held
                    ids, counts, parts, held = [], [], [], 0
        if ids:
            yield closed()

    rows = doc_rows(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    # Packed bits do not compress.
    rows.mapInArrow(pages, PAGES).write.option("compression", "uncompressed").parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32 and, if asked for, its ids."""
    stored = spark.read.schema(PAGES).parquet(path)

    def decoded(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                at = {name: batch.column(name)[row] for name in batch.schema.names}
                counts = at["doc_tokens"].values.to_numpy().astype(np.int64)
                ids = pfor.unpack(
                    np.frombuffer(at["payload"].as_buffer(), np.uint8),
                    at["block_starts"].values.to_numpy(),
                    at["n_ids"].as_py(),
                )
                ends = np.cumsum(counts)
                begins = ends - counts
                raw = [ids[a:b].astype("<u4").tobytes() for a, b in zip(begins, ends, strict=True)]
                yield pa.record_batch(
                    [
                        pa.array(np.full(len(raw), at["shard"].as_py(), np.int32)),
                        pa.array(at["first"].as_py() + begins),
                        at["doc_ids"].values.cast(pa.int64()),
                        pa.array(counts),
                        pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                        pa.array(raw if with_ids else [None] * len(raw), pa.binary()),
                    ],
                    schema=_DOCS,
                )

    docs = stored.mapInArrow(decoded, "shard int, before long, doc_id long, n_tokens long, ids_crc32 long, ids binary")
    # One row per shard: a running total over the list of files, never over documents.
    totals = stored.groupBy("shard").agg(F.sum("n_ids").alias("held"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base"))
    out = docs.join(bases, "shard").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "ids"
    )
    return out if with_ids else out.drop("ids")
